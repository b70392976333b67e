"""Benchmark decontamination by Wu-Manber search over words."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Carried, U, bucketed, hashes_of, mix, partitions, small_batches, stage, text_bytes, words_of

WINDOW = 13
#: Bytes of benchmark text that one pass over the documents searches for; what is broadcast is about eight times as much.
BLOCK_BYTES = 12 << 20
LANE = 512

WORD = np.zeros(256, bool)  # [^\x00-\x2F\x3A-\x60\x7B-\x7F] once A-Z is lower case
WORD[0x30:0x3A] = WORD[0x41:0x5B] = WORD[0x61:0x7B] = WORD[0x80:] = True


@dataclass
class Words:
    """Texts as words: hashes, places of their bytes, and where each text's words begin."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> "Words":
        data, off = text_bytes(column)
        start, end, doc = words_of(data, off, WORD)
        data = LOWER[data]
        return cls(data, start, end, hashes_of(data, start, end),
                   np.searchsorted(doc, np.arange(len(off)), "left"))

    def compact(self) -> "Words":
        """With places of 32 bits, which a block of the benchmark does not exceed."""
        if len(self.data) < 1 << 31:
            self.start, self.end = self.start.astype(np.int32), self.end.astype(np.int32)
        return self


def block_hash(h: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Of the size words that end at each place."""
    out = h[at]
    for back in range(1, size):
        out = mix(out * U(0x9E3779B97F4A7C15) + h[at - back])
    return out


@dataclass
class Tables:
    """Wu-Manber tables for strings of the same number of words: the distance that a last block allows to advance, and
    the strings by their own last block. Flat arrays only; a table has room for eight times the benchmark's words."""

    words: int
    block: int
    bits: int
    shift: np.ndarray
    suffix: np.ndarray            # sorted upper halves of the hashes of last blocks
    starts: np.ndarray            # first benchmark word of each string, in this order
    owners: np.ndarray            # items that hold it: those from first_owner[i] up to first_owner[i + 1]
    first_owner: np.ndarray

    @classmethod
    def build(cls, bench: Words, words: int, starts: np.ndarray, items: np.ndarray) -> "Tables":
        whole = block_hash(bench.hash, starts + words - 1, words)
        order = np.argsort(whole, kind="stable")
        starts, items, whole = starts[order], items[order], whole[order]
        new = np.ones(len(starts), bool)
        new[1:] = whole[1:] != whole[:-1]
        same = np.flatnonzero(~new)
        new[same] = ~same_words(bench, bench, starts[same - 1], starts[same], words)  # equal hashes are compared by bytes
        string = np.cumsum(new) - 1
        pair = np.unique(string * (int(items.max()) + 1) + items)
        string, owner = pair // (int(items.max()) + 1), pair % (int(items.max()) + 1)
        firsts = starts[new]

        block = min(3, words)
        bits = min(28, max(10, int(8 * len(bench.hash)).bit_length()))
        shift = np.full(1 << bits, words - block + 1, np.uint8)
        for at in range(block - 1, words):
            slot = (block_hash(bench.hash, firsts + at, block) >> U(64 - bits)).astype(np.int64)
            np.minimum.at(shift, slot, np.uint8(words - 1 - at))
        suffix = upper(block_hash(bench.hash, firsts + words - 1, block))
        order = np.argsort(suffix, kind="stable")
        count = np.bincount(string, minlength=len(firsts))
        begin = np.cumsum(count) - count
        take = np.repeat(begin[order] - (np.cumsum(count[order]) - count[order]), count[order]) + np.arange(len(owner))
        return cls(words, block, bits, shift, suffix[order], firsts[order].astype(np.int32), owner[take].astype(np.int32),
                   np.concatenate([[0], np.cumsum(count[order])]).astype(np.int32))

    def candidates(self, doc: Words) -> np.ndarray:
        """Last words of places that the shift table does not rule out. Documents are cut
        into lanes, which advance side by side, each by its own shift."""
        n = np.diff(doc.first)
        ends = [np.zeros(0, np.int64)]
        if not (n >= self.words).any():
            return ends[0]
        lanes = np.maximum(0, -(-(n - self.words + 1) // LANE))
        which = np.repeat(np.arange(len(n)), lanes)
        rank = np.arange(len(which)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = doc.first[which] + self.words - 1 + rank * LANE
        stop = np.minimum(at + LANE, doc.first[which + 1])
        while len(at):
            step = self.shift[(block_hash(doc.hash, at, self.block) >> U(64 - self.bits)).astype(np.int64)]
            if (hit := step == 0).any():
                ends.append(at[hit])
            at = at + np.maximum(step, 1)
            keep = at < stop
            if not keep.all():
                at, stop = at[keep], stop[keep]
        return np.concatenate(ends)

    def search(self, doc: Words, bench: Words, most: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
        """First word in doc and number of the string, for each occurrence."""
        ends = self.candidates(doc)
        tail = upper(block_hash(doc.hash, ends, self.block)) if len(ends) else np.zeros(0, np.uint32)
        low, high = np.searchsorted(self.suffix, tail, "left"), np.searchsorted(self.suffix, tail, "right")
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        cut = np.searchsorted(np.cumsum(high - low), np.arange(0, int((high - low).sum()) + most, most)) if len(ends) else [0]
        for i, j in zip([*cut], [*cut[1:], len(ends)], strict=True):
            k = (high - low)[i:j]
            place = np.repeat(ends[i:j] - self.words + 1, k)
            bucket = np.repeat(low[i:j], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            string, begin = bucket, self.starts[bucket].astype(np.int64)
            same = np.ones(len(place), bool)
            for w in range(self.words):
                same[same] = doc.hash[place[same] + w] == bench.hash[begin[same] + w]
            place, string = place[same], string[same]
            same = same_words(doc, bench, place, begin[same], self.words)
            found.append((place[same], string[same]))
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def upper(h: np.ndarray) -> np.ndarray:
    return (h >> U(32)).astype(np.uint32)


def same_words(a: Words, b: Words, i: np.ndarray, j: np.ndarray, words: int) -> np.ndarray:
    """Whether the words from i and from j are the same, byte for byte."""
    ok = np.ones(len(i), bool)
    for w in range(words):
        s, t = i + w, j + w
        size = a.end[s] - a.start[s]
        fit = size == b.end[t] - b.start[t]
        ok &= fit
        s, t, size = s[fit], t[fit], size[fit]
        total = int(size.sum())
        step = np.arange(total) - np.repeat(np.cumsum(size, dtype=np.int64) - size, size)
        differ = a.data[np.repeat(a.start[s], size) + step] != b.data[np.repeat(b.start[t], size) + step]
        wrong = np.repeat(np.flatnonzero(fit), size)[differ]
        ok[wrong] = False
    return ok


@dataclass
class Searcher:
    bench: Words
    ids: list[str]
    tables: list[Tables] = field(default_factory=list)

    @classmethod
    def build(cls, items: list[tuple[str, str]]) -> "Searcher":
        bench = Words.of(pa.array([t for _, t in items], pa.string()))
        n = np.diff(bench.first)
        words = np.minimum(WINDOW, n)
        windows = np.where(n > 0, n - words + 1, 0)
        item = np.repeat(np.arange(len(items)), windows)
        start = bench.first[item] + np.arange(len(item)) - np.repeat(np.cumsum(windows) - windows, windows)
        tables = [Tables.build(bench, int(m), start[words[item] == m], item[words[item] == m]) for m in np.unique(words[item])]
        return cls(bench.compact(), [i for i, _ in items], tables)

    def scan(self, column: pa.Array) -> tuple[np.ndarray, list[list[int]], list[list[int]], list[list[str]]]:
        """Number of words, first words of hit spans and words behind their last, and items of each text."""
        doc = Words.of(column)
        docs = len(column)
        edge = np.zeros(len(doc.hash) + 1, np.int64)
        pairs = [np.zeros((0, 2), np.int64)]
        for t in self.tables:
            place, string = t.search(doc, self.bench)
            np.add.at(edge, place, 1)
            np.add.at(edge, place + t.words, -1)
            owner = np.searchsorted(doc.first, place, "right") - 1
            d, s = np.unique(np.column_stack([owner, string]), axis=0).T if len(place) else (owner, string)
            n = t.first_owner[s + 1].astype(np.int64) - t.first_owner[s]
            at = np.repeat(t.first_owner[s] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            pairs.append(np.column_stack([np.repeat(d, n), t.owners[at]]))
        items: list[set[str]] = [set() for _ in range(docs)]
        for d, i in np.unique(np.concatenate(pairs), axis=0).tolist():
            items[d].add(self.ids[i])
        hit = np.cumsum(edge[:-1]) > 0
        first, last = hit.copy(), hit.copy()
        first[1:] &= ~hit[:-1]
        last[:-1] &= ~hit[1:]
        cuts = doc.first[1:-1][(doc.first[1:-1] > 0) & (doc.first[1:-1] < len(hit))]
        first[cuts], last[cuts - 1] = hit[cuts], hit[cuts - 1]
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        begins, ends = [[[] for _ in range(docs)] for _ in range(2)]
        for d, s, e in zip((np.searchsorted(doc.first, begin, "right") - 1).tolist(), begin.tolist(), end.tolist(), strict=True):
            begins[d].append(s - int(doc.first[d]))
            ends[d].append(e - int(doc.first[d]))
        return np.diff(doc.first), begins, ends, [sorted(x) for x in items]


ADDED = ["n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated"]
FOUND = "n_words bigint, begins array<bigint>, ends array<bigint>, items array<string>"


def searched(rows: DataFrame, searcher) -> DataFrame:
    """rows, which have a column text, with FOUND."""
    def scan(batches):
        for batch in small_batches(batches, "text"):
            n, begins, ends, items = searcher.value.scan(batch.column("text"))
            found = [pa.array(n, pa.int64()), pa.array(begins, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-4], *found], names=batch.schema.names)

    shape = rows.select("*", *(F.lit(None).cast(kind).alias(c) for c, kind in (x.split(" ") for x in FOUND.split(", "))))
    return shape.mapInArrow(scan, shape.schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, n_hit, n_items, items (sorted), items_sha256 and contaminated.

    Words are runs of characters other than ASCII non-alphanumerics, A-Z lower-cased. Each
    13 consecutive words of an item, or all if it has fewer, are searched for; a word of a
    document inside an occurrence is hit; contaminated are documents with a hit of which a
    twentieth of the words or more is hit.

    The benchmark is broadcast in blocks of at most block_bytes of text (or one item), so that
    neither the driver nor a task holds more than one block. Of several blocks each is a pass
    over a stored copy of the texts that writes hits only; these come together by row. Documents
    are not shuffled, each is a row of its own. Null text has no words; items with null or wordless
    text match nothing; a null item_id counts as "". Repeated rows are kept, repeated items are one
    if their ids are alike. Columns of docs with the names above, in any case, are replaced; empty tables work.
    """
    own = Carried(docs, ADDED)
    if "text" not in own.rows.columns:
        raise ValueError("docs need a column text")
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.col("text").alias("t")).dropna()
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // max(1, block_bytes // 2))) if total > block_bytes else 1
    share = lambda df: spark.sparkContext.broadcast(Searcher.build([tuple(r) for r in df.collect()]))
    if blocks == 1:
        rows = searched(own.rows, share(items)).withColumn("spans", F.arrays_zip("begins", "ends"))
    else:
        texts = bucketed(own.rows.withColumn("row_id", F.monotonically_increasing_id()), "row_id", partitions(docs))
        found = None
        for b in range(blocks):
            part = searched(texts.select("row_id", "text"), share(items.filter(F.pmod(F.xxhash64("id", "t"), F.lit(blocks)) == b))).drop("text")
            part = stage(part if b == 0 else part.filter("size(begins) > 0"))  # the first counts the words of all
            found = part if found is None else found.union(part)
        met = found.groupBy("row_id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list(F.arrays_zip("begins", "ends")))).alias("spans"),
                                          F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        rows = texts.join(met, "row_id")
    hit = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("n")), lambda a, s: F.struct(
        F.greatest(a["at"], s["ends"]).alias("at"), (a["n"] + F.greatest(F.lit(0).cast("long"), s["ends"] - F.greatest(a["at"], s["begins"]))).alias("n")), lambda a: a["n"])
    return own.restored(rows.withColumn("n_hit", hit).withColumn("n_items", F.size("items").cast("long"))
                        .withColumn("items_sha256", F.sha2(F.array_join("items", ",").cast("binary"), 256))
                        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))))
