"""Removal of byte strings that occur earlier, found by a hash-compared suffix sort."""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, U, Prefix, bucketed, mix, partitions, small_batches, stage, text_bytes

LENGTH = 100   # bytes of a repeated string
GRAM = 32      # bytes of an anchor; each string of LENGTH bytes holds the anchor that its content selects
GROUP = 2000   # contexts of one anchor that are sorted in one group
OTHER = 0xD1B54A32D192ED03  # base of the second fingerprint
PLACE = 23     # bits of a place within a part of a batch; the others rank anchors
PART = 4 << 20 # starts of strings that are looked at together, of a very long text too


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[:len(v) - (width - size)], v[width - size:]) if width > size else v


def anchors(data: np.ndarray, off: np.ndarray):
    """Strings of LENGTH bytes, as runs of starts (first, last) with the same anchor: the text of
    each, first, last, hash of the anchor, and both halves of a 128-bit digest of the run's bytes and the anchor's place in them."""
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.int64, np.int64))
    if len(data) < LENGTH:
        return empty
    p = Prefix(data)
    at = np.arange(len(data) - GRAM + 1)
    gram = mix(p.of(at, GRAM))
    low = U((1 << PLACE) - 1)
    own = (sliding_min((gram & ~low) | at.astype(np.uint64), LENGTH - GRAM + 1) & low).astype(np.int64)
    room = np.repeat(off[1:], np.diff(off))[:len(own)] - np.arange(len(own)) >= LENGTH
    start = np.flatnonzero(room)
    if not len(start):
        return empty
    own = own[start]
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (start[1:] != start[:-1] + 1)]))
    first, last = start[new], start[np.concatenate([new[1:] - 1, [len(start) - 1]])]
    raw = data.tobytes()
    digests = b"".join([xxhash.xxh3_128_digest(raw[a:b], s) for a, b, s in zip(first.tolist(), (last + LENGTH).tolist(), (own[new] - first).tolist(), strict=True)])
    whole = np.frombuffer(digests, np.int64).reshape(-1, 2)
    return np.searchsorted(off, first, "right") - 1, first, last, gram[own[new]], whole[:, 0], whole[:, 1]


def parts(batch):
    """Bytes, offsets, texts and what is before them: of a batch, or of each PART of a very long text, with
    as many bytes more as its last string has. So anchors are the same wherever a string stands."""
    data, off = text_bytes(batch.column("text"))
    if len(data) <= PART + LENGTH:
        yield data, off, 0
    else:  # one row, as batches are small
        for a in range(0, len(data) - LENGTH + 1, PART):
            own = data[a:a + PART + LENGTH - 1]
            yield own, np.array([0, len(own)]), a


def merge(doc: np.ndarray, begin: np.ndarray, end: np.ndarray):
    """Touching spans of one document, given in order, as one."""
    if not len(doc):
        return doc, begin, end
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (begin[1:] > end[:-1])]))
    return doc[new], begin[new], end[np.concatenate([new[1:] - 1, [len(doc) - 1]])]


def find_anchors(batches):
    """Rows (done, gram, whole, check, doc_id, row_id, first, last). Within a batch, only the first of equal
    runs goes on; the others repeat it, and are done: they travel as merged spans, by row."""
    for batch in small_batches(batches, "text"):
        rows = batch.column("row_id").to_numpy()
        ids = batch.column("doc_id")
        key = ids.fill_null(np.iinfo(np.int64).min).to_numpy()
        rank = np.empty(len(rows), np.int64)
        rank[np.lexsort((rows, key))] = np.arange(len(rows))
        for data, off, before in parts(batch):
            doc, first, last, gram, whole, check = anchors(data, off)
            order = np.lexsort((first, rank[doc], check, whole, gram))
            same = np.zeros(len(order), bool)
            same[1:] = np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in (gram, whole, check)])
            repeated = np.zeros(len(order), bool)
            repeated[order] = same
            new = ~repeated
            d2, b2, e2 = merge(doc[repeated], first[repeated], last[repeated] + LENGTH)
            d, none = np.concatenate([doc[new], d2]), np.zeros(len(d2), np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([np.zeros(new.sum(), bool), np.ones(len(d2), bool)])),
                pa.array(np.concatenate([gram[new], mix(rows[d2].astype(np.uint64) + U(1))]).view(np.int64)),
                pa.array(np.concatenate([whole[new], none])), pa.array(np.concatenate([check[new], none])),
                ids.take(pa.array(d)), pa.array(rows[d]),
                pa.array(np.concatenate([first[new], b2]) - off[d] + before), pa.array(np.concatenate([last[new], e2]) - off[d] + before)],
                names=["done", "gram", "whole", "check", "doc_id", "row_id", "first", "last"])


def judge_anchors(batches, group: int = GROUP):
    """Sorted rows of find_anchors to spans that repeat, and to runs that need a closer look: the first
    of each content, if its anchor has several. Only the last anchor's state goes from batch to batch."""
    before = None   # (gram, whole, check) of the last row
    held = None     # the first run of the last anchor, not known yet to need a look
    count = 0       # contents of the last anchor so far
    for batch in batches:
        done = batch.column("done").to_numpy(zero_copy_only=False)
        yield spans(batch.filter(pa.array(done)), "last", 0)
        batch = batch.filter(pa.array(~done))
        if not batch.num_rows:
            continue
        own = g, w, c = [batch.column(x).to_numpy() for x in ("gram", "whole", "check")]
        same = np.zeros(len(g), bool)
        same[1:] = (g[1:] == g[:-1]) & (w[1:] == w[:-1]) & (c[1:] == c[:-1])
        same[0] = before == tuple(x[0] for x in own)
        carried = before[0] if before else None
        before = tuple(x[-1] for x in own)
        yield spans(batch.filter(pa.array(same)), "last", LENGTH)
        fresh = batch.filter(pa.array(~same))
        if not fresh.num_rows:
            continue
        g = fresh.column("gram").to_numpy()
        head = np.concatenate([[True], g[1:] != g[:-1]])
        begin = np.flatnonzero(head)[np.cumsum(head) - 1]
        rank = np.arange(len(g)) - begin + np.where(begin == 0, count if carried == g[0] else 0, 0)
        if held is not None and g[0] == held.column("gram")[0].as_py():
            yield looks(held, np.zeros(1, np.int64), group)
        held, count = None, int(rank[-1]) + 1
        several = rank > 0
        several[:-1] |= ~head[1:]
        if not several[-1]:
            held = fresh.slice(len(g) - 1)
        pick = pa.array(several)
        yield looks(fresh.filter(pick), rank[several], group)


FOUND = "part int, gram bigint, doc_id bigint, row_id bigint, first bigint, last bigint"
FOUND_NAMES = ["part", "gram", "doc_id", "row_id", "first", "last"]


def spans(batch, last: str, more: int):
    """part -1: the bytes from first up to last repeat."""
    n = batch.num_rows
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(n, -1, np.int32)), pa.array(np.zeros(n, np.int64)), batch.column("doc_id"), batch.column("row_id"),
        batch.column("first"), pa.array(batch.column(last).to_numpy() + more)], names=FOUND_NAMES)


def looks(batch, rank: np.ndarray, group: int):
    return pa.RecordBatch.from_arrays([pa.array((rank // group).astype(np.int32)), *(batch.column(c) for c in FOUND_NAMES[1:])], names=FOUND_NAMES)


def cut_contexts(batches):
    """The bytes of each run that needs a look."""
    for batch in small_batches(batches, "text"):
        data, off = text_bytes(batch.column("text"))
        runs = batch.column("runs")
        count = runs.value_lengths().to_numpy()
        doc = np.repeat(np.arange(len(count)), count)
        flat = runs.flatten()
        first, last = flat.field("first").to_numpy(), flat.field("last").to_numpy()
        raw = data.tobytes()
        bytes_ = [raw[a:b] for a, b in zip((off[doc] + first).tolist(), (off[doc] + last + LENGTH).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([
            flat.field("gram"), flat.field("part"), flat.field("hot"), batch.column("doc_id").take(pa.array(doc)),
            batch.column("row_id").take(pa.array(doc)), pa.array(first), pa.array(bytes_, pa.binary())],
            names=["gram", "part", "hot", "doc_id", "row_id", "first", "bytes"])


class Suffixes:
    """Suffixes of contexts, compared over LENGTH bytes by hashes of their prefixes."""

    def __init__(self, data: np.ndarray, at: np.ndarray, group: np.ndarray):
        self.data, self.at, self.group, self.prefix = data, at, group, Prefix(data)
        self.hash = self.prefix.of(at, LENGTH)

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for each two suffixes: the common extension by binary search, then the next byte."""
        out = np.zeros(len(a), np.int8)
        differ = np.flatnonzero(self.hash[a] != self.hash[b])
        x, y = self.at[a[differ]], self.at[b[differ]]
        low, high = np.zeros(len(x), np.int64), np.full(len(x), LENGTH - 1)
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.prefix.of(x, middle) == self.prefix.of(y, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        out[differ] = np.where(self.data[x + low] < self.data[y + low], -1, 1)
        return out

    def sorted(self) -> tuple[np.ndarray, np.ndarray]:
        """Order by group and bytes, equal ones as given; and which equal their predecessor.

        Eight bytes are compared as a number first; ties are put in order by mergesort, in
        which all runs of a width find their places in their partners' side by side.
        """
        view = sliding_window_view(self.data, 8)[self.at]
        lead = np.ascontiguousarray(view).view(">u8")[:, 0].astype(np.uint64)
        order = np.lexsort((lead, self.group))
        new = np.ones(len(order), bool)
        new[1:] = (lead[order][1:] != lead[order][:-1]) | (self.group[order][1:] != self.group[order][:-1])
        begin = np.flatnonzero(new)[np.cumsum(new) - 1]
        size = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
        tied = np.flatnonzero(size > 1)
        width, most = 1, int(size.max()) if len(size) else 0
        while width < most:
            slot = tied[size[tied] > width]
            offset = slot - begin[slot]
            run = offset // width
            left = run % 2 == 0
            a = begin[slot] + np.where(left, run + 1, run - 1) * width
            stop = begin[slot] + size[slot]
            low, high = np.minimum(a, stop), np.minimum(a + width, stop)
            a = low.copy()
            mine = order[slot]
            while (live := np.flatnonzero(low < high)).size:
                middle = (low[live] + high[live]) // 2
                c = self.compare(order[middle], mine[live])
                under = np.where(left[live], c < 0, c <= 0)
                low[live] = np.where(under, middle + 1, low[live])
                high[live] = np.where(under, high[live], middle)
            place = begin[slot] + run // 2 * 2 * width + offset % width + (low - a)
            moved = order.copy()
            moved[place] = mine
            order, width = moved, width * 2
        same = np.zeros(len(order), bool)
        same[1:] = ~new[1:] & (self.hash[order][1:] == self.hash[order][:-1])
        pair = np.flatnonzero(same)
        whole = sliding_window_view(self.data, LENGTH)
        for i in range(0, len(pair), 1 << 16):  # equal hashes are checked byte for byte
            part = pair[i:i + (1 << 16)]
            same[part] = (whole[self.at[order[part]]] == whole[self.at[order[part - 1]]]).all(1)
        return order, same


def sort_contexts(batches):
    """Sorted contexts to spans that repeat. An anchor with more than GROUP contents also sends on
    the first of equal strings, for its groups to be compared with one another."""
    for chunk in whole_groups(batches):
        data, off = text_bytes(chunk.column("bytes"))
        n = np.diff(off) - LENGTH + 1
        row = np.repeat(np.arange(len(n)), n)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        g, part = chunk.column("gram").to_numpy(), chunk.column("part").to_numpy()
        group = np.cumsum(np.concatenate([[0], (g[1:] != g[:-1]) | (part[1:] != part[:-1])]))
        s = Suffixes(data, off[row] + inside, group[row])
        order, same = s.sorted()
        again = np.zeros(len(order), bool)
        again[order] = same
        at = chunk.column("first").to_numpy()[row] + inside
        d, b, e = merge(row[again], at[again], at[again] + LENGTH)
        hot = np.flatnonzero(~again & chunk.column("hot").to_numpy(zero_copy_only=False)[row])
        other = Prefix(data, OTHER).of(s.at[hot], LENGTH)
        take = np.concatenate([d, row[hot]])
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([np.ones(len(d), bool), np.zeros(len(hot), bool)])),
            pa.array(np.concatenate([np.zeros(len(d), np.uint64), mix(s.hash[hot])]).view(np.int64)),
            pa.array(np.concatenate([np.zeros(len(d), np.uint64), mix(other)]).view(np.int64)),
            chunk.column("doc_id").take(pa.array(take)), chunk.column("row_id").take(pa.array(take)),
            pa.array(np.concatenate([b, at[hot]])), pa.array(np.concatenate([e, at[hot] + LENGTH]))],
            names=["repeats", "h1", "h2", "doc_id", "row_id", "first", "last"])


def whole_groups(batches, most: int = 1 << 20):
    """Batches of at least ``most`` bytes of context that end where a group ends."""
    kept, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        g, part = batch.column("gram").to_numpy(), batch.column("part").to_numpy()
        lengths = np.diff(text_bytes(batch.column("bytes"))[1])
        start = 0
        edges = np.concatenate([[0], np.flatnonzero((g[1:] != g[:-1]) | (part[1:] != part[:-1])) + 1])
        if kept and (kept[-1].column("gram")[-1].as_py(), kept[-1].column("part")[-1].as_py()) == (g[0], part[0]):
            edges = edges[1:]
        total = np.concatenate([[0], np.cumsum(lengths)])
        for e in edges.tolist():
            if size + total[e] - total[start] >= most:
                kept.append(batch.slice(start, e - start))
                yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
                kept, size, start = [], 0, e
        kept.append(batch.slice(start))
        size += int(total[-1] - total[start])
        kept = [b for b in kept if b.num_rows]
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]


def judge_fingerprints(batches):
    """Sorted strings of hot anchors: all but the first of equal fingerprints repeat."""
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = batch.column("h1").to_numpy(), batch.column("h2").to_numpy()
        same = np.zeros(len(a), bool)
        same[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        same[0] = before == (a[0], b[0])
        before = (a[-1], b[-1])
        yield batch.filter(pa.array(same)).select(["row_id", "first", "last"])


def apply_spans(batches):
    for batch in small_batches(batches, "text"):
        data, off = text_bytes(batch.column("text"))
        raw, bounds = data.tobytes(), off.tolist()
        removed, runs, digests, texts = [], [], [], []
        for i, found in enumerate(batch.column("spans").to_pylist()):
            text, out, at = raw[bounds[i]:bounds[i + 1]], [], 0
            gone = n = 0
            end = -1
            for s in sorted((s["first"], s["last"]) for s in found or ()):
                if s[0] > end:
                    out.append(text[at:s[0]])
                    n += 1
                    gone += s[1] - s[0]
                else:
                    gone += max(0, s[1] - end)
                at = end = max(end, s[1])
            out.append(text[at:])
            kept = b"".join(out)
            removed.append(gone)
            runs.append(n)
            digests.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept.decode(errors="ignore"))
        yield pa.RecordBatch.from_arrays([
            *(batch.column(i) for i, c in enumerate(batch.schema.names) if c not in ("text", "spans")),
            pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())],
            names=[*(c for c in batch.schema.names if c not in ("text", "spans")), "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])


def remove_repeats(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the text that is left of each row.

    Each byte goes that a string of LENGTH bytes covers which also starts earlier: in a
    smaller doc_id, or further ahead in the same document; strings are judged on the input.
    text is what is left, without bytes of characters that were cut.

    Each string holds an anchor that its content selects. Texts are cut into runs of strings
    with the same anchor; runs with the same anchor and 128-bit digest repeat as a whole, and of
    different runs with the same anchor the suffixes are sorted, and equal ones compared by bytes. Rows go by anchor, equal ones of a batch first being
    made one; an anchor with over ``group`` different runs is split over several groups, whose
    first strings are then compared by fingerprints of 128 bits.

    Null text counts as empty. Of rows with the same doc_id, the order in which they are
    read decides; a null doc_id comes first. Texts under LENGTH bytes stay. Further columns
    are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = bucketed(rows, "row_id", partitions(docs))
    seen = texts.mapInArrow(find_anchors, "done boolean, gram bigint, whole bigint, check bigint, doc_id bigint, row_id bigint, first bigint, last bigint")
    found = stage(seen.repartition("gram").sortWithinPartitions("gram", "whole", "check", "doc_id", "row_id", "first").mapInArrow(partial(judge_anchors, group=group), FOUND))
    look = found.filter("part >= 0")
    hot = stage(look.filter("part > 0").select("gram").distinct())
    look = look.join(hot.withColumn("hot", F.lit(True)), "gram", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    runs = look.groupBy("row_id").agg(F.collect_list(F.struct("gram", "part", "hot", "first", "last")).alias("runs"))
    contexts = (texts.join(runs, "row_id").select("doc_id", "row_id", "text", "runs")
                .mapInArrow(cut_contexts, "gram bigint, part int, hot boolean, doc_id bigint, row_id bigint, first bigint, bytes binary")
                .repartition("gram", "part").sortWithinPartitions("gram", "part", "doc_id", "row_id", "first"))
    strings = stage(contexts.mapInArrow(sort_contexts, "repeats boolean, h1 bigint, h2 bigint, doc_id bigint, row_id bigint, first bigint, last bigint"))
    others = (strings.filter("NOT repeats").repartition("h1").sortWithinPartitions("h1", "h2", "doc_id", "row_id", "first")
              .mapInArrow(judge_fingerprints, "row_id bigint, first bigint, last bigint"))
    spans_ = (found.filter("part < 0").select("row_id", "first", "last").union(strings.filter("repeats").select("row_id", "first", "last")).union(others)
              .groupBy("row_id").agg(F.collect_list(F.struct("first", "last")).alias("spans")))
    return texts.join(spans_, "row_id", "left").select("doc_id", "text", "spans").mapInArrow(
        apply_spans, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, text string")
