"""Exact search of the highest inner products by reading sorted lists, without random access."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import QUERY_BLOCK, Best, first_ranks, in_cells, integer_vectors, matrix, rows_of

#: Parts of the lists that are read before each look at the bounds.
DEPTHS = (0.25, 0.5, 0.625, 0.75, 0.875, 1.0)
#: A query stops when at most this part of a block's rows (or k of them) can still qualify; their scores are then resolved.
FEW = 1 / 32
#: Up to here sums of integers are exact in float64.
EXACT = 2**53


class Lists:
    """A block's values as one sorted list a dimension, read from both its ends: weights above 0 want its top, those below 0 its bottom.

    ``upper`` and ``lower`` have, for each row and list, the value where it has been read, else the values that were read last at the two ends,
    between which it must be.
    """

    def __init__(self, x: np.ndarray):
        self.order = np.argsort(-x, axis=0, kind="stable")
        self.values = np.take_along_axis(x, self.order, 0).astype(np.float64)
        self.seen, self.depth = np.zeros(x.shape, bool), 0
        self.upper, self.lower = np.repeat(self.values[:1], len(x), 0), np.repeat(self.values[-1:], len(x), 0)

    def read(self, part: float) -> None:
        """Go on until that part of every list has been read."""
        n = len(self.values)
        depth = min(-(-n // 2), max(1, int(n * part / 2) if part < 1 else n))
        for span in (slice(self.depth, depth), slice(n - depth, n - self.depth)):
            for known, values in ((self.seen, True), (self.upper, self.values[span]), (self.lower, self.values[span])):
                np.put_along_axis(known, self.order[span], values, 0)
        np.copyto(self.upper, self.values[depth - 1], where=~self.seen)
        np.copyto(self.lower, self.values[n - depth], where=~self.seen)
        self.depth = depth

    def bounds(self, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of all rows' scores for queries of weights up - down, both at least 0."""
        return up @ self.upper.T - down @ self.lower.T, up @ self.lower.T - down @ self.upper.T


class Search:
    """The first k rows of each of a cell's queries."""

    def __init__(self, queries: pa.Table, k: int, largest: int):
        self.row, self.id = queries["row"].to_numpy(), queries["id"].combine_chunks()
        self.x, self.k, self.largest = matrix(queries["vec"]), k, largest
        self.best = Best(len(self.row), k)
        self.read = self.resolved = 0  # entries of each list, and scores

    def offer(self, batch: pa.RecordBatch) -> None:
        for row, ids, known, x, _ in rows_of(batch):
            wide = max(x.shape[1], self.x.shape[1])
            x, mine = (np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (x, self.x))
            self.block(mine, row, ids, known, x)

    def block(self, mine, row, ids, known, x) -> None:
        n, wide = x.shape
        lists = Lists(x)
        most = wide * self.largest * self.largest
        slack = 0.0 if most < EXACT else wide * most * 2.0**-50
        open_ = [np.arange(i, min(i + QUERY_BLOCK, len(mine))) for i in range(0, len(mine), QUERY_BLOCK)]
        for part in (0.0, *DEPTHS):
            if part:
                lists.read(part)
            for j, q in enumerate(open_):
                if not len(q):
                    continue
                up, down = np.maximum(mine[q], 0).astype(np.float64), np.maximum(-mine[q], 0).astype(np.float64)
                if not part:  # before anything is read: can any row of the block qualify?
                    open_[j] = q[up @ lists.upper[0] - down @ lists.lower[0] + slack >= self.best.last(q)]
                    continue
                upper, lower = lists.bounds(up, down)
                own = self.row[q, None] == row
                lower[own] = -np.inf
                bar = self.best.last(q).astype(np.float64)
                if n >= self.k:
                    bar = np.maximum(bar, np.partition(lower, n - self.k, axis=1)[:, n - self.k] - slack)
                near = (upper + slack >= bar[:, None]) & ~own  # rows at the bar may win by their ids
                done = near.sum(1) <= max(self.k, FEW * n) if part < 1 else np.ones(len(q), bool)
                at, col = np.nonzero(near & done[:, None])
                self.resolve(q, at, col, mine, x, ids, known)
                self.read += int(done.sum()) * min(2 * lists.depth, n)
                open_[j] = q[~done]

    def resolve(self, q, at, col, mine, x, ids, known, most: int = 1 << 16) -> None:
        """Final scores of what may qualify, as exact integers."""
        for i in range(0, len(at), most):
            a, c = at[i:i + most], col[i:i + most]
            score = np.einsum("ij,ij->i", mine[q[a]], x[c])
            last = self.best.score[q[a], -1]
            good = (score > last) | ((score == last) & (ids[c] < self.best.id[q[a], -1]))
            self.best.merge(q, a[good], score[good], ids[c[good]], known[c[good]])
            self.resolved += len(a)

    def results(self):
        at, ids, score = self.best.found()
        yield pa.record_batch({"row": self.row[at], "query_id": self.id.take(pa.array(at)), "id": ids, "score": score})


def top_k(table: DataFrame, queries: str = "id % 100 = 0", k: int = 10, scale: int = 1024, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k rows with the highest inner products with each query, all others of the table being candidates.

    Components are floor(scale * x), scores integer inner products, ties go to smaller ids; queries is a condition on ``id``.
    Returns query_id, rank (from 1), vec_id, score.

    Each block of rows is kept as sorted lists (``Lists``). They are read from their ends, in steps; after each step every row has an upper and
    a lower bound for every query. A query stops when hardly any row can still reach the k-th best lower bound, of this block or of
    those before; the scores of these few are then resolved. No other row is scored. The bounds of many queries at once are matrix products.
    All queries meet all rows in the cells of ``vectors.in_cells``.

    Rows with a null vector or a component that is null or not finite take no part. Vectors of other lengths count as ended by zeros, an
    empty one scores 0. A row with a null id is no query and comes last among ties. Rows that repeat (also with one id) are rows
    of their own: each is a query, and a candidate for the others. Fewer than k candidates are all returned; no rows give no rows. Scores that
    might not fit in 64 bits raise OverflowError. Other columns of the table do not matter.
    """
    ready = integer_vectors(table, scale, queries, key, vector)
    largest = ready.largest
    found = in_cells(ready.rows.filter(queries), ready, lambda held: Search(held, k, largest), "row long, query_id long, id long, score long")
    return first_ranks(found, ["row"], k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
