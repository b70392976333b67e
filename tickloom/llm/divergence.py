"""How the vocabulary of each source differs from that of the other sources of its language."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, partitions, small_batches, stage, text_bytes, words_of

#: Bytes of a term: ASCII letters and all bytes of characters beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Counts that a task holds before it hands them on.
HELD = 1 << 20
#: Sources of a language whose pairs a task sums at once; values of terms that it holds as a table.
SOURCES, CELLS = 1024, 1 << 20
#: Kept terms of a language for each task that sums its pairs.
PIECE = 1 << 11
MILLIARD = 1_000_000_000


def radix_order(columns: list[np.ndarray]) -> np.ndarray:
    """Stable order by unsigned columns, the first one counting most: passes over 16 bits each from the last digit on, which
    numpy sorts by counting. Digits that are the same everywhere are skipped."""
    order = None
    for column in columns[::-1]:
        digits = np.ascontiguousarray(column.astype("<u8")).view("<u2").reshape(-1, 4)
        for i in range(4):
            digit = digits[:, i]
            if len(digit) and (digit != digit[0]).any():
                step = np.argsort(digit if order is None else digit[order], kind="stable")
                order = step if order is None else order[step]
    return np.arange(len(columns[0])) if order is None else order


def runs(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order by the columns, and where runs of equal values begin in it."""
    order = radix_order(columns)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([(c := column[order])[1:] != c[:-1] for column in columns])
    return order, np.flatnonzero(new)


#: Terms whose bytes are gathered at once.
SLICE = 1 << 18


def packed(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """data[start:start + size] of at most 8 bytes as numbers in which bytes compare from the left; there is no zero byte in a term."""
    out, place = np.zeros(len(start), np.uint64), np.arange(8)
    for i in range(0, len(start), SLICE):
        at, n = start[i:i + SLICE, None] + place, size[i:i + SLICE, None]
        taken = np.where(place < n, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)
        out[i:i + SLICE] = taken.view(">u8").ravel()
    return out


class Terms:
    """Numbers for the terms of a batch, in three buckets: terms of up to 8 bytes are one 64-bit word, up to 16 two words, longer ones are sorted as bytes."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        size = end - start
        self.number, self.first = np.zeros(len(start), np.int64), []
        for n, bucket in enumerate((size <= 8, (size > 8) & (size <= 16), size > 16)):
            at = np.flatnonzero(bucket)
            if not len(at):
                continue
            if n < 2:
                words = [packed(data, start[at], np.minimum(size[at], 8))]
                if n:
                    words.append(packed(data, start[at] + 8, size[at] - 8))
                order, new = runs(words)
            else:
                terms = [data[a:b].tobytes() for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
                order = np.array(sorted(range(len(terms)), key=terms.__getitem__), np.int64)
                new = np.array([i for i, o in enumerate(order) if not i or terms[o] != terms[order[i - 1]]], np.int64)
            self.number[at[order]] = len(self.first) + np.searchsorted(new, np.arange(len(at)), "right") - 1
            self.first.extend(at[order[new]].tolist())
        self.first = np.array(self.first, np.int64)  # an occurrence of each


def cut(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """data[start:start + size] as strings."""
    to = np.zeros(len(start) + 1, np.int64)
    np.cumsum(size, out=to[1:])
    taken = data[np.arange(to[-1]) + np.repeat(start - to[:-1], size)]
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(to), pa.py_buffer(taken)).cast(pa.string())


def group_codes(table: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, Callable]:
    """A number for each row's language and source, and what gives them back."""
    codes = [(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).dictionary_encode() for c in (table.column("lang"), table.column("source"))]
    width = max(len(codes[1].dictionary), 1)
    back = lambda g: {"lang": codes[0].dictionary.take(pa.array(g // width)), "source": codes[1].dictionary.take(pa.array(g % width))}
    return codes[0].indices.to_numpy().astype(np.int64) * width + codes[1].indices.to_numpy(), back


def counted(batch: pa.RecordBatch) -> pa.Table | None:
    """lang, source, term, n (occurrences) and docs (documents that have it) of a batch of documents."""
    data, off = text_bytes(batch.column("text"))
    data = LOWER[data]
    start, end, doc = words_of(data, off, LETTERS)
    if not len(start):
        return None
    terms = Terms(data, start, end)
    code, back = group_codes(batch)
    group = code[doc]
    order, new = runs([terms.number, group, doc])  # runs of one term in one document
    times, first = np.diff(np.append(new, len(order))), order[new]
    number, group = terms.number[first], group[first]
    change = np.ones(len(first), bool)
    change[1:] = (number[1:] != number[:-1]) | (group[1:] != group[:-1])
    at = np.flatnonzero(change)
    one = terms.first[number[at]]
    return pa.table(back(group[at]) | {"term": cut(data, start[one], (end - start)[one]), "n": np.add.reduceat(times, at), "docs": np.diff(np.append(at, len(first)))})


def merged(tables: list[pa.Table]) -> pa.Table:
    """One row for each language, source and term, by the same sorts."""
    table = pa.concat_tables(tables)
    data, off = text_bytes(table.column("term"))
    number = Terms(data, off[:-1], off[1:]).number
    code, back = group_codes(table)
    order, new = runs([number, code])
    sums = {c: np.add.reduceat(table.column(c).to_numpy()[order], new) for c in ("n", "docs")}
    return pa.table(back(code[order[new]]) | {"term": table.column("term").take(pa.array(order[new]))} | sums)


def counts(batches):
    """``counted`` of a task's documents, merged each time that more than HELD rows are held."""
    held, size = [], 0
    for batch in small_batches(batches, "text"):
        if (table := counted(batch)) is None:
            continue
        held.append(table)
        size += table.num_rows
        if size > HELD:
            held = [merged(held)]
            size = held[0].num_rows
            if size > HELD // 2:
                yield from held.pop().to_batches(max_chunksize=1 << 16)
                size = 0
    if held:
        yield from merged(held).to_batches(max_chunksize=1 << 16)


def shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * n / total), by long division in thousands; exact for totals below 9e15."""
    whole, rest = n // total, n % total
    for _ in range(3):
        rest = rest * 1000
        whole, rest = whole * 1000 + rest // total, rest % total
    return 1 + whole


class Pairs:
    """Sums over terms of the differences between each source of a block and all sources of its language."""

    def __init__(self, lang: str, block: int, header: list[dict], v: int):
        self.lang, self.v, self.names = lang, v, pa.array([h["source"] for h in header], pa.string())
        self.total = np.array([h["n"] for h in header], np.int64) + 5 * v
        self.mine = range(block * SOURCES, min((block + 1) * SOURCES, len(header)))
        self.sums = np.zeros((len(self.mine), len(header)), np.int64)

    def add(self, entries: pa.ListArray) -> None:
        """entries: of some terms the counts of the sources that have them."""
        wide = len(self.total)
        step = max(1, CELLS // wide)
        for i in range(0, len(entries), step):
            part = entries.slice(i, step)
            flat, off = part.flatten(), part.offsets.to_numpy()
            n = np.zeros((len(part), wide), np.int64)
            n[np.repeat(np.arange(len(part)), np.diff(off)), pc.index_in(flat.field("source"), value_set=self.names).to_numpy()] = flat.field("n").to_numpy()
            p = shares(n + 5, self.total)
            for j, g in enumerate(self.mine):
                self.sums[j] += np.abs(p - p[:, g, None]).sum(0)

    def rows(self):
        for j, g in enumerate(self.mine):
            others = pa.array(np.delete(np.arange(len(self.total)), g))
            yield pa.record_batch({"lang": pa.array([self.lang] * len(others), pa.string()), "source": self.names.take(pa.array([g] * len(others), pa.int64())),
                                   "item": self.names.take(others), "value": self.sums[j][others.to_numpy()]})


def pair_sums(batches):
    """Rows come by cell, a cell's first row having the sources (side 0), the others terms."""
    key, pairs = None, None
    for batch in batches:
        lang, block, piece, side = (batch.column(c) for c in ("lang", "block", "piece", "side"))
        cells = list(zip(lang.dictionary_encode().indices.to_numpy().tolist(), block.to_numpy().tolist(), piece.to_numpy().tolist(), strict=True))
        cuts = [0, *(i for i in range(1, len(cells)) if cells[i] != cells[i - 1]), len(cells)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            now = (lang[a].as_py(), *cells[a][1:])
            if now != key:
                if pairs:
                    yield from pairs.rows()
                assert side[a].as_py() == 0
                key, pairs = now, Pairs(now[0], now[1], batch.column("entries")[a].as_py(), batch.column("v")[a].as_py())
                a += 1
            if a < b:
                pairs.add(batch.column("entries").slice(a, b - a))
    if pairs:
        yield from pairs.rows()


def source_divergence(docs: DataFrame, least_docs: int = 30, top: int = 50, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Part "pair": how far each two sources of a language are apart. Part "term": the terms that a source has more often than its language.

    Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased. A language keeps its V terms that are in at least
    least_docs of its documents. A source of a language, and the language as a whole, gives a term the share
    1 + floor(10**9 * (n + 5) / (N + 5 * V)), n being the term's occurrences there and N those of all kept terms. The value of a pair is
    the sum over the kept terms of the differences of the two shares (0 if V is 0); that of a term its share in the source less that in the
    language, for terms of the source where this is above 0, of which the first ``top`` are returned. Ranks go by value, then item in the order of its bytes.
    Returns lang, source, part, item, value, rank. All arithmetic is exact for up to 9e15 occurrences.

    Tasks count the terms of their own documents: terms of up to 8 bytes are packed into one 64-bit word, up to 16 into two, radix-sorted
    and counted as runs; longer ones are sorted as bytes. What is shuffled is one row for each source, term and task. Pairs are summed from a table of the
    shares of some terms at a time, so no pair is made for a single term.

    Null texts, languages and sources are read as ''. Empty texts have no terms, but their source counts as one. Each of repeated rows counts.
    A very long text is counted by one task, in memory of some times its size. No documents give no rows. Other columns do not matter.
    """
    own = docs.select(*(F.coalesce(docs[c].cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))))
    parts = partitions(docs)
    found = own.mapInArrow(counts, "lang string, source string, term string, n long, docs long").repartition(parts, "lang", "term")
    terms = found.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).groupBy("lang", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("entries"))
    kept = stage(terms.filter(F.col("docs") >= least_docs).select("lang", "term", "n", "entries"))
    single = kept.select("lang", "term", F.col("n").alias("all"), F.inline("entries"))
    sizes = single.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total"))
    groups = own.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "v", "lang_total"])
    groups = stage(groups)

    share = lambda n, total: F.expr(f"1 + (cast({n} + 5 as decimal(20, 0)) * 1000000000) div ({total} + 5 * v)")
    over = single.join(groups, ["lang", "source"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (share("n", "total") - share("all", "lang_total")).alias("value"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))
    over = ranked(over.filter("value > 0")).filter(F.col("rank") <= top)

    widest = groups.groupBy("lang").agg(F.count("*").alias("sources"), F.max("v").alias("v")).agg(F.max("sources"), F.max("v")).first()
    blocks, pieces = -(-(widest[0] or 1) // SOURCES), min(parts, max(1, -(-(widest[1] or 0) // PIECE)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    header = (groups.groupBy("lang").agg(F.max("v").alias("v"), F.array_sort(F.collect_list(F.struct("source", F.col("total").alias("n")))).alias("entries"))
              .withColumn("side", F.lit(0)).withColumn("piece", every(pieces)))
    rows = kept.select("lang", F.lit(0).cast("long").alias("v"), "entries", F.lit(1).alias("side"), F.pmod(F.xxhash64("term"), F.lit(pieces)).cast("int").alias("piece"))
    cells = header.select(*rows.columns).union(rows).withColumn("block", every(blocks)).repartition(parts, "lang", "block", "piece").sortWithinPartitions("lang", "block", "piece", "side")
    pairs = cells.mapInArrow(pair_sums, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = ranked(pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value"))
    return pairs.union(over)
