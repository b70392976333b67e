"""Vectors of integers, and the scoring of a query set against all rows in the cells of a grid."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stage

#: Bytes of query vectors, as 64-bit numbers, that a task holds; of rows' vectors that pass through it.
QUERY_BYTES, PIECE_BYTES = 8 << 20, 256 << 20
#: Queries and rows that are scored at once.
QUERY_BLOCK, ROW_BLOCK = 512, 2048
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


@dataclass
class Integers:
    """rows: row (unique), id, label, vec; and what bounds them."""

    rows: DataFrame
    n: int
    n_queries: int
    dim: int
    largest: int  # of all components, without sign
    bound: int  # of all inner products, without sign


def integer_vectors(table: DataFrame, scale: int, queries: str, key: str, vector: str, label: Column | None = None) -> Integers:
    """Each component x of a vector as floor(scale * x), written once, so that row numbers stay what they are.

    Rows without a label (if one is asked for) or a vector, or with a component that is null or not finite,
    are left out. Inner products must be 64-bit numbers: by the vectors' lengths none may reach 2**63.
    queries is a condition on ``id``; rows for which it is null are no queries.
    """
    x = F.col("given").cast("array<double>")
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    rows = (table.select(table[key].cast("long").alias("id"), (F.lit("") if label is None else label.cast("string")).alias("label"), table[vector].alias("given"))
            .filter(F.col("given").isNotNull() & F.col("label").isNotNull()).filter(F.forall(x, fine))
            .select(F.monotonically_increasing_id().alias("row"), "id", "label", F.transform(x, lambda v: F.floor(v * scale)).alias("vec")))
    rows = stage(rows)
    square = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    largest = F.greatest(F.abs(F.array_max("vec").cast("double")), F.abs(F.array_min("vec").cast("double")))
    found = rows.agg(F.count("*").alias("n"), F.count_if(F.expr(queries)).alias("q"), F.max(F.size("vec")).alias("dim"), F.max(largest).alias("largest"), F.max(square).alias("square")).first()
    bound = int((found["square"] or 0) * (1 + 1e-6)) + 1
    if bound >= 2**63:
        raise OverflowError("inner products of these vectors can be larger than 64-bit numbers: choose a smaller scale")
    largest = int(found["largest"] or 0)
    kind = "int" if largest < 2**31 else "bigint"
    return Integers(rows.withColumn("vec", F.col("vec").cast(f"array<{kind}>")), found["n"], found["q"], found["dim"] or 0, largest, bound)


def matrix(column: pa.Array, least: int = 0) -> np.ndarray:
    """Lists of integers as rows; shorter ones, and all up to ``least`` columns, end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    off = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)[off[0]:off[-1]].astype(np.int64)
    sizes = np.diff(off)
    wide = max(int(sizes.max(initial=0)), least)
    if len(values) == len(sizes) * wide:
        return values.reshape(len(sizes), wide)
    out = np.zeros((len(sizes), wide), np.int64)
    out[np.arange(wide) < sizes[:, None]] = values
    return out


class Best:
    """The first k rows of those that each query was offered: higher scores first, ties by smaller ids, null ids last."""

    def __init__(self, n: int, k: int):
        self.k, self.score = k, np.full((n, k), LEAST)
        self.id, self.known = np.full((n, k), MOST), np.zeros((n, k), bool)

    def last(self, queries) -> np.ndarray:
        """The scores that rows must reach to count."""
        return self.score[queries, -1]

    def offer(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        """scores: a row for each of the queries, a column for each id; LEAST where there is no pair."""
        last, n = self.score[queries, -1:], scores.shape[1]
        hit = (scores > last) | ((scores == last) & (ids < self.id[queries, -1:]))
        if n > self.k and hit.sum() > 4 * self.k * len(queries):
            hit &= scores >= np.partition(scores, n - self.k, axis=1)[:, n - self.k, None]
        at, col = np.nonzero(hit & (scores > LEAST))
        self.merge(queries, at, scores[at, col], ids[col], known[col])

    def merge(self, queries: np.ndarray, at: np.ndarray, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        """Single pairs: ``at`` says of which of the queries."""
        if not len(at):
            return
        m = len(queries)
        at = np.concatenate([np.repeat(np.arange(m), self.k), at])
        score, ids, known = (np.concatenate([old[queries].ravel(), new]) for old, new in ((self.score, score), (self.id, ids), (self.known, known)))
        order = np.lexsort((ids, ~score, at))
        at = at[order]
        order = order[np.arange(len(at)) - np.searchsorted(at, np.arange(m))[at] < self.k]
        for old, new in ((self.score, score), (self.id, ids), (self.known, known)):
            old[queries] = new[order].reshape(m, self.k)

    def found(self) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Query, id and score of all."""
        at, col = np.nonzero(self.score > LEAST)
        return at, pa.array(self.id[at, col], mask=~self.known[at, col]), self.score[at, col]


def rows_of(batch: pa.RecordBatch):
    """row, ids, which ids are known, vectors, and the labels' column, of each ROW_BLOCK rows."""
    for i in range(0, batch.num_rows, ROW_BLOCK):
        part = batch.slice(i, ROW_BLOCK)
        ids = part.column("id")
        yield (part.column("row").to_numpy(), pc.fill_null(ids, int(MOST)).to_numpy(), pc.is_valid(ids).to_numpy(zero_copy_only=False), matrix(part.column("vec")), part.column("label"))


def in_cells(queries: DataFrame, ready: Integers, task: Callable, schema: str) -> DataFrame:
    """Each query meets each row in one task, each task being a cell of a grid.

    Queries are dealt into groups of at most about QUERY_BYTES, rows into pieces; a cell has one of each: it holds the group's
    queries, and its rows pass through in batches. So a query is sent once for each piece and a row once for each group; all cells
    are alike in size, whatever the values are, and a lost one is computed again from the staged rows.
    task(table of queries) gives an object with offer(batch of rows) and results().
    """
    size = 8 * max(ready.dim, 1)
    groups = max(1, -(-ready.n_queries * size // QUERY_BYTES))
    pieces = max(-(-partitions(ready.rows) // groups), -(-ready.n * size // PIECE_BYTES))
    deal = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("side", F.lit(0)).withColumn("group", deal(groups, 1)).withColumn("piece", every(pieces))
    right = ready.rows.withColumn("side", F.lit(1)).withColumn("piece", deal(pieces, 2)).withColumn("group", every(groups))
    cells = left.unionByName(right, allowMissingColumns=True).withColumn("cell", F.col("group") * pieces + F.col("piece")).drop("group", "piece")

    def run(batches):
        held, search = [], None
        for batch in batches:
            n = int(np.searchsorted(batch.column("side").to_numpy(), 1))
            if n:
                held.append(batch.slice(0, n))
            if n < batch.num_rows and held:
                search = search or task(pa.Table.from_batches(held))
                search.offer(batch.slice(n))
        if search:
            yield from search.results()

    return cells.repartitionById(groups * pieces, "cell").sortWithinPartitions("side").drop("cell").mapInArrow(run, schema)


def first_ranks(found: DataFrame, query: list[str], k: int) -> DataFrame:
    """The first k of all cells' rows for a query, with their rank."""
    order = Window.partitionBy(*query).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
