"""Small helpers shared by the text operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, UPPER.lower())


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; without that
    setting one of this machine, if all runs on it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-tickloom-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/tickloom-{uuid.uuid4().hex}"
    _OPEN[-1].append(path)
    return path


_OPEN: list[list[str]] = [[]]  # folders and tables of each open scope


@contextlib.contextmanager
def staged_until_end(spark: SparkSession):
    """What is staged inside is removed at the end; what must stay is written elsewhere before."""
    _OPEN.append([])
    try:
        yield
    finally:
        drop_staged(spark, _OPEN.pop())


def drop_staged(spark: SparkSession, names: list[str] | None = None) -> None:
    """Removes staged tables and folders (of the session so far, if none are named); results that read them are of no use any more."""
    names = names if names is not None else _OPEN[0]
    for name in names:
        if name.startswith("table "):
            spark.sql(f"DROP TABLE IF EXISTS {name[6:]}")
        else:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    names.clear()


def stage(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, survives lost
    executors, and gives the planner real sizes."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


MOST_BUCKETS = 200  # that each task writes files of


def bucketed(df: DataFrame, key: str, n: int) -> DataFrame:
    """``stage``, bucketed by key, so that later joins on key do not move df's rows.

    A task writes a file for each bucket, so tasks times buckets files; beyond MOST_BUCKETS the rows
    are dealt to the buckets by a shuffle first, and there is one file a bucket.
    """
    spark, name = df.sparkSession, f"tickloom_{uuid.uuid4().hex}"
    rows = df.repartition(n, key) if n > MOST_BUCKETS else df
    (rows.write.option("path", shared_dir(spark)).option("compression", "zstd")
     .bucketBy(n, key).saveAsTable(name))
    _OPEN[-1].append(f"table {name}")
    return spark.table(name)


PART_BYTES, MOST_PARTS = 128 << 20, 20_000


def partitions(df: DataFrame) -> int:
    """The session's shuffle partitions, or one for each PART_BYTES of the files that df reads, if that is more."""
    leaves, total = df._jdf.queryExecution().optimizedPlan().collectLeaves(), 0
    for i in range(leaves.size()):
        size = int(leaves.apply(i).stats().sizeInBytes())
        total += size if size < 1 << 60 else 0  # rows that are in no file have no known size
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, -(-total // PART_BYTES)))


class Carried:
    """Rows of docs under names of their own (text stays text), for an operator to add columns to without meeting theirs.

    restored gives them back with the columns added; columns of docs that bear the name of one, in
    any case, are replaced.
    """

    def __init__(self, docs: DataFrame, added: list[str]):
        taken = {a.lower() for a in added}
        self.names, self.added = [c for c in docs.columns if c.lower() not in taken], added
        self.place = {c: "text" if c.lower() == "text" else f"given {i}" for i, c in enumerate(self.names)}
        self.rows = docs.select(*(docs[f"`{c.replace('`', '``')}`"].alias(p) for c, p in self.place.items()))

    def col(self, name: str) -> Column:
        return F.col(next(p for c, p in self.place.items() if c.lower() == name.lower()))

    def restored(self, df: DataFrame) -> DataFrame:
        return df.select(*(F.col(p).alias(c) for c, p in self.place.items()), *self.added)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts after one another and the n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.cast(pc.fill_null(column, ""), pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None and len(off) else np.zeros(0, np.uint8)
    return data, off - off[0]


def small_batches(batches, column: str, most: int = 4 << 20):
    """The rows in batches of at most ``most`` bytes of text, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if i > start and total + size > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start)


# --- hashing of byte strings -------------------------------------------------

U = np.uint64
BASE = 0x9E3779B97F4A7C15
SYMBOL = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), U(base % 2**64))
        have[0] = 1
        _POWERS[base] = have = np.cumprod(have)
    return have[:n]


class Prefix:
    """Prefix polynomial hashes of bytes: the hash of any substring in a few operations."""

    def __init__(self, data: np.ndarray, base: int = BASE):
        n = len(data)
        self.inverse = powers(pow(base, -1, 2**64), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(SYMBOL[data] * powers(base, n), out=self.sums[1:])

    def of(self, start, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.inverse[start]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words_of(data: np.ndarray, off: np.ndarray, is_word: np.ndarray):
    """Start, end and document of each maximal run of word bytes."""
    inside = is_word[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def hashes_of(data: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = 4 << 20) -> np.ndarray:
    """64-bit hash of each data[start:end], in blocks so that a long text needs no long tables."""
    out, i = np.zeros(len(start), np.uint64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + block, "right")))
        a = start[i]
        p = Prefix(data[a:end[j - 1]])
        out[i:j] = p.of(start[i:j] - a, end[i:j] - start[i:j])
        i = j
    return mix(out + (end - start).astype(np.uint64))
