"""Hard negatives by exact scores from a residue number system."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage
from .vectors import LEAST, QUERY_BLOCK, Best, first_ranks, in_cells, integer_vectors, matrix, rows_of

#: Nearly as large as eight bits allow: sums of DEPTH products of two balanced residues stay below 2**24, which float32 holds exactly.
PRIMES = (251, 241, 239, 233, 229, 227, 223, 211, 199, 197)
DEPTH = 1024


def primes_for(bound: int) -> list[int]:
    """As many moduli as tell apart all integers from -bound to bound."""
    out, product = [], 1
    for p in PRIMES:
        if product > 2 * bound:
            break
        out.append(p)
        product *= p
    if product <= 2 * bound:
        raise OverflowError(f"scores up to {bound} need more moduli")
    return out


def balanced(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo p, from -(p - 1) / 2 to (p - 1) / 2."""
    x = x + x.dtype.type(p // 2)
    return x - x // p * x.dtype.type(p) - x.dtype.type(p // 2)


def residues(x: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    return [balanced(x, p).astype(np.float32) for p in primes]


def product_residues(a: list[np.ndarray], b: list[np.ndarray], primes: list[int]) -> list[np.ndarray]:
    """a @ b.T modulo each prime, from float32 products that are exact."""
    out = []
    for x, y, p in zip(a, b, primes, strict=True):
        wide, total = min(x.shape[1], y.shape[1]), None  # what one of them lacks is zero
        for i in range(0, max(wide, 1), DEPTH):
            part = balanced((x[:, i:min(i + DEPTH, wide)] @ y[:, i:min(i + DEPTH, wide)].T).astype(np.int32), p)
            total = part if total is None else balanced(total + part, p)
        out.append(total)
    return out


def reconstruct(r: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The signed integers with these residues, by Chinese remaindering in mixed radix: the digits are balanced, so
    the sum is the one value nearest to zero, and no step leaves 64 bits if that value does not."""
    digits: list[np.ndarray] = []
    for i, p in enumerate(primes):
        t = r[i]
        for d, q in zip(digits, primes, strict=False):
            t = balanced((t - d) * np.int32(pow(q, -1, p)), p)
        digits.append(t)
    out = digits[-1].astype(np.int64)
    for d, p in zip(digits[-2::-1], primes[-2::-1], strict=False):
        out = out * p + d
    return out


class Scorer:
    """Scores of a cell's queries; ``best`` keeps the first rows of each query's slots."""

    def __init__(self, queries: pa.Table, bound: int, slots: int, k: int):
        self.queries, self.primes, self.slots = queries.combine_chunks(), primes_for(bound), slots
        self.row, self.labels = queries["row"].to_numpy(), queries["label"].combine_chunks().unique()
        self.label = self.code(queries["label"])
        self.parts = residues(matrix(queries["vec"]), self.primes)
        self.best = Best(len(self.row) * slots, k)

    def code(self, labels) -> np.ndarray:
        """Labels as numbers; -1 for what is no query's label."""
        return np.asarray(pc.fill_null(pc.index_in(labels, value_set=self.labels), -1))

    def offer(self, batch: pa.RecordBatch) -> None:
        for row, ids, known, x, labels in rows_of(batch):
            parts, label = residues(x, self.primes), self.code(labels)
            for i in range(0, len(self.row), QUERY_BLOCK):
                q = np.arange(i, min(i + QUERY_BLOCK, len(self.row)))
                scores = reconstruct(product_residues([p[q] for p in self.parts], parts, self.primes), self.primes)
                self.keep(q, scores, self.label[q, None] == label, self.row[q, None] == row, ids, known)


class Positives(Scorer):
    """Rows of the same label but the anchor itself."""

    def __init__(self, queries: pa.Table, bound: int, k: int):
        super().__init__(queries, bound, 1, k)

    def keep(self, q, scores, same, own, ids, known) -> None:
        self.best.offer(q, np.where(same & ~own, scores, LEAST), ids, known)

    def results(self):
        at, ids, score = self.best.found()
        yield pa.record_batch({"row": self.row[at], "id": ids, "score": score})


class Negatives(Scorer):
    """Rows of other labels inside the window of each of an anchor's positives, which are its slots."""

    def __init__(self, queries: pa.Table, bound: int, k: int, low: int, high: int):
        off = queries["positives"].combine_chunks().offsets.to_numpy()
        sizes = np.diff(off)
        super().__init__(queries, bound, int(sizes.max()), k)
        self.given = self.queries["positives"].combine_chunks().flatten()
        n = len(self.row)
        self.place = np.full((n, self.slots), -1)
        self.place[np.arange(self.slots) < sizes[:, None]] = np.arange(len(self.given))
        score = self.given.field("score").to_numpy()
        hundreds, rest = score // 100, score % 100
        self.least, self.most = np.full((n, self.slots), 1), np.full((n, self.slots), 0)
        self.least[self.place >= 0], self.most[self.place >= 0] = low * hundreds - -low * rest // 100, high * hundreds + high * rest // 100

    def keep(self, q, scores, same, own, ids, known) -> None:
        others = np.where(same, LEAST, scores)
        for s in range(self.slots):
            inside = (others >= self.least[q, s, None]) & (others <= self.most[q, s, None])
            self.best.offer(q * self.slots + s, np.where(inside, others, LEAST), ids, known)

    def results(self):
        at, ids, score = self.best.found()
        place = self.place.ravel()[at]
        yield pa.record_batch({"row": self.row[at // self.slots], "anchor_id": self.queries["id"].combine_chunks().take(at // self.slots), "slot": self.given.field("slot").take(place),
                               "positive_id": self.given.field("id").take(place), "positive_score": self.given.field("score").take(place), "id": ids, "score": score})


def hard_negatives(table: DataFrame, anchors: str = "id % 100 = 0", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
                   key: str = "vec_id", vector: str = "embedding", label: Column | str = "label") -> DataFrame:
    """For each anchor and each of its positives the rows of other labels that score nearly as high.

    Components are floor(scale * x), a score is the integer inner product with the anchor; higher scores come first, ties by smaller
    ids. anchors is a condition on ``id``; positives are the anchor's first rows of its own label; negatives the first of the
    other rows whose score is from low to high hundredths of the positive's (so a positive below zero has none). Fewer rows give fewer.
    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Scores are exact: matrices of residues modulo small primes are multiplied in float32, and Chinese remaindering puts the products
    together; primes_for says how many moduli the table's longest vectors need. All anchors are compared with all rows, in the cells of
    ``vectors.in_cells``: once for the positives, again for the windows that these set.

    Rows with a null label or vector or a component that is null or not finite take no part. Vectors of other lengths count as ended by
    zeros, an empty one scores 0. A row with a null id is no anchor, may be returned, and comes last among ties. Rows that repeat (also
    with one id) are rows of their own: each may be an anchor, a positive, a negative. No rows give no rows. Scores that might not
    fit in 64 bits raise OverflowError. Other columns of the table do not matter.
    """
    if not -100 <= low <= high <= 100:
        raise ValueError("low and high are hundredths from -100 to 100")
    ready = integer_vectors(table, scale, anchors, key, vector, table[label] if isinstance(label, str) else label)
    chosen = ready.rows.filter(anchors)
    bound = ready.bound
    met = in_cells(chosen, ready, lambda queries: Positives(queries, bound, positives), "row long, id long, score long")
    firsts = first_ranks(met, ["row"], positives).groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("slot"), "id", "score"))).alias("positives"))
    chosen = stage(chosen.join(firsts, "row"))
    found = in_cells(chosen, ready, lambda queries: Negatives(queries, bound, negatives, low, high),
                     "row long, anchor_id long, slot int, positive_id long, positive_score long, id long, score long")
    return first_ranks(found, ["row", "slot"], negatives).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


