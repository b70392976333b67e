"""Line dedup by winnowing: the minima of windows of lines are fingerprints, whose places are joined and extended to whole runs."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, partitions, small_batches, stage

WORDS = 3            # words of a window, and so of the shortest run that is deleted
BYTES_OF_WORD = 16   # a line has a word for each so many bytes at least, as some scripts have no blanks


def lines_of(text: str) -> tuple[list[str], list[int]]:
    """All lines, and the places of those that are not blank."""
    lines = text.split("\n")
    return lines, [i for i, x in enumerate(lines) if x.strip()]


def weighed(text: str, words: int) -> tuple[list[str], list[int]]:
    """The lines that are not blank, without surrounding white space, and their words, counted up to a window's."""
    lines = [x for x in (line.strip() for line in text.split("\n")) if x]
    enough = words * BYTES_OF_WORD
    return lines, [words if (n := len(x.encode())) >= enough else min(words, max(len(x.split()), n // BYTES_OF_WORD)) for x in lines]


def windows(weights: list[int], words: int) -> list[tuple[int, int]]:
    """The shortest run of at least so many words from each line on, and up to each line.

    Each line of any run of so many words is in one of these that lies in that run: in the one from it
    on, or else in the one up to it, or else in the one from the run's first line on.
    """
    n, found = len(weights), set()
    if not n or min(weights) >= words:
        return [(i, i + 1) for i in range(n)]
    last = total = 0
    for first in range(n):
        while last < n and total < words:
            total += weights[last]
            last += 1
        if total < words:
            break
        found.add((first, last))
        total -= weights[first]
    first, total = n, 0
    for last in range(n, 0, -1):
        while first > 0 and total < words:
            first -= 1
            total += weights[first]
        if total < words:
            break
        found.add((first, last))
        total -= weights[last - 1]
    return sorted(found)


def minimum(hashes: list[int], window: tuple[int, int]) -> int:
    """The line that a window selects: the last one of the least hash in it."""
    first, last = window
    if last == first + 1:
        return first
    least = min(hashes[first:last])
    return max(i for i in range(first, last) if hashes[i] == least)


def fingerprints(words: int):
    """Which lines of a text its windows select, and their hashes. Equal runs of a window's words select equal lines."""
    def run(batches):
        for batch in small_batches(batches, "text"):
            rows, places, prints = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                lines, weights = weighed(text or "", words)
                hashes = [xxhash.xxh3_64_intdigest(x) for x in lines]
                chosen = sorted({minimum(hashes, w) for w in windows(weights, words)})
                rows += [i] * len(chosen)
                places += chosen
                prints += [hashes[k] for k in chosen]
            yield pa.RecordBatch.from_arrays([batch.column("row_id").take(pa.array(rows, pa.int64())), pa.array(places, pa.int32()), pa.array(np.array(prints, np.uint64).view(np.int64))], names=["row_id", "place", "print"])

    return run


def extended(words: int):
    """From a text's fingerprints that stand elsewhere too, the whole windows to both sides of each: their first and last line, and 128 bits of what they hold."""
    def run(batches):
        for batch in small_batches(batches, "text"):
            rows, first, last, digests = [], [], [], []
            for i, (text, places) in enumerate(zip(batch.column("text").to_pylist(), batch.column("places").to_pylist(), strict=True)):
                if not places:
                    continue
                (lines, weights), known = weighed(text or "", words), set(places)
                hashes = [xxhash.xxh3_64_intdigest(x) for x in lines] if min(weights) < words else []
                for a, b in windows(weights, words):
                    if (a if b == a + 1 else minimum(hashes, (a, b))) in known:
                        rows.append(i)
                        first.append(a)
                        last.append(b)
                        digests.append(xxhash.xxh3_128_digest(lines[a] if b == a + 1 else "\n".join(lines[a:b])))
            take = pa.array(rows, pa.int64())
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([
                batch.column("row_id").take(take), batch.column("doc_id").take(take), pa.array(first, pa.int64()), pa.array(last, pa.int64()),
                pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], names=["row_id", "doc_id", "first", "last", "h", "g"])

    return run


def delete_runs(batches):
    for batch in small_batches(batches, "text"):
        count, gone, runs, digests, texts = [], [], [], [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            lines, full = lines_of(text or "")
            cut = np.zeros(len(lines) + 1, np.int64)
            for s in spans or ():
                cut[full[s["first"]]] += 1
                cut[full[s["last"] - 1] + 1] -= 1
            drop = np.cumsum(cut)[:-1] > 0
            left = "\n".join(x for x, d in zip(lines, drop, strict=True) if not d)
            count.append(len(lines))
            gone.append(int(drop.sum()))
            runs.append(int((drop & ~np.concatenate([[False], drop[:-1]])).sum()))
            digests.append(hashlib.sha256(left.encode()).hexdigest())
            texts.append(left)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (count, gone, runs)), pa.array(digests, pa.string()),
                                          pa.array(texts, pa.string())], names=["doc_id", "n_lines", "n_removed", "n_spans", "kept_sha256", "text"])


def remove_repeated_lines(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed, n_spans, kept_sha256 and the text that is left of each row.

    Lines are compared without surrounding white space, blank ones are passed over (and go
    with a run that they stand in). A run of at least so many words, of any number of lines,
    is deleted from its first to its last line if it stands further ahead: in a row of smaller
    doc_id or before in its own. A line counts its words, or one for each BYTES_OF_WORD bytes
    if that is more. A line's first place always stays.

    A window is the shortest run of so many words from a line on, or up to a line; it selects its line of the least hash, the last of several. Texts
    that share a run of so many words select the same lines of it, so only places of fingerprints that stand at two places or more go on.
    From these, the windows that selected them are compared whole (by 128 bits), and each that stands further ahead marks its
    lines; as windows overlap, the marks extend a match to both sides up to the first and last line of the longest repeated run. A run is whole
    even if its parts have their first places in several texts.

    Each window is joined with its one first place, never all pairs; what both joins look up is written before, so that Spark can split the
    places of a line that is in very many texts over tasks. Null text is one
    empty line. Of rows with the same doc_id, the order in which they are read decides; a null
    doc_id comes first. Further columns are ignored; an empty table gives no rows.
    """
    if words < 1:
        raise ValueError("a run has one word at least")
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = bucketed(rows, "row_id", partitions(docs))
    prints = stage(texts.mapInArrow(fingerprints(words), "row_id bigint, place int, print bigint"))
    twice = stage(prints.groupBy("print").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("print"))
    places = prints.join(twice, "print", "left_semi").groupBy("row_id").agg(F.collect_list("place").alias("places"))
    whole = stage(texts.join(places, "row_id").mapInArrow(extended(words), "row_id bigint, doc_id bigint, first bigint, last bigint, h bigint, g bigint"))
    firsts = stage(whole.groupBy("h", "g").agg(F.min(F.struct("doc_id", "row_id", "first")).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1")
                   .select("h", "g", F.col("f.row_id").alias("other_id"), F.col("f.first").alias("other_first")))
    spans = (whole.join(firsts, ["h", "g"]).filter((F.col("row_id") != F.col("other_id")) | (F.col("first") != F.col("other_first")))
             .groupBy("row_id").agg(F.collect_list(F.struct("first", "last")).alias("spans")))
    return texts.join(spans, "row_id", "left").select("doc_id", "text", "spans").mapInArrow(
        delete_runs, "doc_id bigint, n_lines bigint, n_removed bigint, n_spans bigint, kept_sha256 string, text string")
