"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, union-find."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Carried, U, bucketed, hashes_of, mix, partitions, small_batches, stage, text_bytes, words_of

SHINGLE = 5
PERCENT = 80            # link from this Jaccard similarity
ROWS, MISSED = 5, 1e-7  # slots of a band; chance of a pair at that similarity to share no band
GROUP = 64              # members that one task compares with a leader
BLOCK = 256             # members of a band that are compared with one another, or with as many others
RARE = 64               # sets that a shingle may lead to one another; those of more frequent ones are compared in blocks
COUNTERS = 20           # bits of the table of counters that orders shingles by how rare they are (8 MB, of any input)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; one of all words if there are under five."""
    data, off = text_bytes(column)
    start, end, doc = words_of(data, off, ~SPACE)
    h = hashes_of(LOWER[data], start, end)
    bound = np.searchsorted(doc, np.arange(len(off)), "left")
    grams = h[:max(len(h) - SHINGLE + 1, 0)].copy()
    for k in range(1, SHINGLE):
        grams = mix(grams * U(0x9E3779B97F4A7C15) + h[k:k + len(grams)])
    out = []
    for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(grams[a:b - SHINGLE + 1]))
        elif b > a:
            one = np.array([b - a], np.uint64)
            for k in range(a, b):
                one = mix(one * U(3) + h[k:k + 1])
            out.append(one)
        else:
            out.append(h[:0])
    return out


def bands_for(percent: int) -> int:
    """28 at 0.85, 41 at 0.8."""
    return math.ceil(math.log(MISSED) / math.log(1 - min(percent / 100, 0.999) ** ROWS))


def superminhash(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """Signatures of non-empty sets. Level j gives each element one more place of its own random
    permutation, with rank j + u; a set is done when every slot has a rank below the next level."""
    size = np.array([len(s) for s in sets], np.int64)
    sig = np.full((len(sets), slots), np.inf)
    element, owner = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(sets)), size)
    drawn: list[np.ndarray] = []  # place that level i swapped with place i
    for j in range(slots):
        if not len(element):
            break
        value = mix(element + U((2 * j + 1) * 0xC2B2AE3D27D4EB4F % 2**64))
        rank = j + (value >> U(11)).astype(float) / 2**53
        place = (j + (mix(value) % U(slots - j))).astype(np.int16)
        slot = place.copy()
        for i in range(j - 1, -1, -1):
            slot[slot == drawn[i]] = i
        drawn.append(place)
        np.minimum.at(sig.reshape(-1), owner * slots + slot, rank)
        going = sig.max(1) >= j + 1
        if not going.all():
            keep = going[owner]
            if not keep.all():
                element, owner, drawn = element[keep], owner[keep], [d[keep] for d in drawn]
    return sig


def signatures(batches, bands: int):
    """row_id, doc_id, n_shingles, both halves of a 128-bit digest of the set, and the hash of each band."""
    for batch in small_batches(batches, "text", 1 << 20):
        sets = shingle_sets(batch.column("text"))
        n = np.array([len(s) for s in sets], np.int64)
        full = np.flatnonzero(n)
        bits = superminhash([sets[i] for i in full], bands * ROWS).view(np.uint64).reshape(-1, bands, ROWS)
        band = np.zeros(bits.shape[:2], np.uint64) + np.arange(bands, dtype=np.uint64)
        for k in range(ROWS):
            band = mix(band * U(0x9E3779B97F4A7C15) + bits[:, :, k])
        digest = np.zeros((len(n), 2), np.int64)
        for i in full:
            digest[i] = np.frombuffer(hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), np.int64)
        offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("row_id"), batch.column("doc_id"), pa.array(n), pa.array(digest[:, 0].copy()),
             pa.array(digest[:, 1].copy()), pa.ListArray.from_arrays(offsets, band.reshape(-1).view(np.int64))],
            names=["row_id", "doc_id", "n_shingles", "d1", "d2", "bands"])


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def verified(pairs: DataFrame, texts: DataFrame, percent: int, group_size: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets are similar. Each leader a meets its members in
    groups of about group_size; within a task one leader's set is held at a time."""
    sizes = stage(pairs.groupBy("a").agg(F.expr(f"cast(count(1) div {group_size} as int) + 1").alias("groups")))
    dealt = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("part"))
    wanted = dealt.select("a", "part", F.col("b").alias("row_id"), F.lit(1).alias("role")).union(
        dealt.select("a", "part").distinct().select("a", "part", F.col("a").alias("row_id"), F.lit(0).alias("role")))
    met = (wanted.join(texts.select("row_id", "text"), "row_id").repartition(partitions(texts), "a", "part")
           .sortWithinPartitions("a", "part", "role"))

    def compare(batches):
        leader, group = None, None
        for batch in small_batches(batches, "text"):
            found = [], []
            sets = shingle_sets(batch.column("text"))
            cols = [batch.column(c).to_pylist() for c in ("a", "part", "row_id", "role")]
            for a, part, row, role, own in zip(*cols, sets, strict=True):
                if role == 0:
                    leader, group = own, (a, part)
                elif group == (a, part) and similar(leader, own, percent):
                    found[0].append(a)
                    found[1].append(row)
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()) for f in found], names=["a", "b"])

    return met.select("a", "part", "row_id", "role", "text").mapInArrow(compare, "a bigint, b bigint")


def forest(batches):
    """Union-find over the links of a task: each node with its root."""
    parent: dict[int, int] = {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    rows = [(x, root(x)) for x in parent]
    for i in range(0, len(rows), 1 << 16):
        part = [(x, r) for x, r in rows[i:i + (1 << 16)] if x != r]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.int64()), pa.array([r for _, r in part], pa.int64())], names=["b", "a"])


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node that it reaches) for all nodes with a link (a, b).

    Each task first contracts its links by union-find; large-star and small-star rounds over
    what is left then point all nodes at the smallest one, until nothing changes.
    """
    edges = stage(links.mapInArrow(forest, "b bigint, a bigint"))  # b > a
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 40))).alias("h")).first()
        if state == seen or not state["n"]:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select("a", "a").distinct())
        seen = state
        both = edges.select(F.col("b").alias("u"), F.col("a").alias("v")).union(edges.select("a", "b"))
        least = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = stage(both.filter("v > u").join(least, "u").select(F.col("v").alias("b"), F.col("m").alias("a")).filter("b != a").distinct())
        down = stage(large.groupBy("b").agg(F.min("a").alias("m")))
        edges = stage(large.join(down, "b").filter("a != m").select(F.col("a").alias("b"), F.col("m").alias("a"))
                      .union(down.select("b", "m")).distinct())


ROUNDS = 2              # of comparing with one leader a band, before all that is still apart is compared


def fits(x: str, y: str, percent: int):
    """Sets of such sizes can be similar."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def still_apart(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of bands that hold more than one component."""
    own = members.join(roots, F.col("row_id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "row_id")).drop("node")
    mixed = stage(own.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("key"))
    return stage(own.join(mixed, "key", "left_semi"))


def links_of_rest(members: DataFrame, texts: DataFrame, bands: DataFrame, percent: int, block: int) -> DataFrame:
    """Links (a, b) among members of a band that differ in root, by comparing all such pairs (of those that only frequent shingles lead to others).

    A band's members are dealt into blocks of about ``block``, and each two blocks meet in one
    group. There all full sets are intersected at once; a pair counts in the first of the bands
    that it shares (in a band that is not here any more it is connected, or one of the two was the
    leader), and of the links only those leave that connect what others do not.
    """
    blocks = stage(members.groupBy("key").agg(F.expr(f"cast(count(1) div {block} as int) + 1").alias("blocks")))
    dealt = (members.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("row_id"), F.col("blocks")).cast("int"))
             .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("row_id", "key", "root", "own", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j")))
    met = (dealt.join(bands, "row_id").join(texts.select("row_id", "text"), "row_id")
           .repartition(partitions(texts), "key", "i", "j").sortWithinPartitions("key", "i", "j", "row_id"))

    def compare(batches):
        group, rows = None, []
        for batch in small_batches(batches, "text"):
            sets = shingle_sets(batch.column("text"))
            cols = [batch.column(c).to_pylist() for c in ("key", "i", "j", "row_id", "root", "own", "bands")]
            for key, i, j, row, root, own, band, grams in zip(*cols, sets, strict=True):
                if (key, i, j) != group:
                    yield links(group, rows)
                    group, rows = (key, i, j), []
                rows.append((row, root, own, band, grams))
        yield links(group, rows)

    def links(group, rows):
        found = [], []
        if len(rows) > 1:
            ids, root, own, band, sets = zip(*rows, strict=True)
            root, own, band, size = np.array(root), np.array(own), np.array(band), np.array([len(x) for x in sets])
            wanted = root[:, None] < root
            if group[1] != group[2]:
                wanted &= own[:, None] != own
            wanted &= np.minimum(size[:, None], size) * 100 >= np.maximum(size[:, None], size) * percent
            for c in range(int((band == group[0]).any(0).argmax())):
                wanted &= band[:, c][:, None] != band[:, c]
            some = np.flatnonzero(wanted.any(0) | wanted.any(1))
            if len(some):
                both = intersections([sets[i] for i in some])
                least = size[some][:, None] + size[some]
                parent: dict[int, int] = {}

                def top(x):
                    while (p := parent.setdefault(x, x)) != x:
                        parent[x] = x = parent[p]
                    return x

                for a, b in np.argwhere(wanted[np.ix_(some, some)] & (both * 100 >= (least - both) * percent)).tolist():
                    x, y = top(root[some[a]]), top(root[some[b]])
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        one, two = ids[some[a]], ids[some[b]]
                        found[0].append(min(one, two))
                        found[1].append(max(one, two))
        return pa.RecordBatch.from_arrays([pa.array(f, pa.int64()) for f in found], names=["a", "b"])

    return met.select("key", "i", "j", "row_id", "root", "own", "bands", "text").mapInArrow(compare, "a bigint, b bigint")


def intersections(sets: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of the intersections of each two sets: products of their indicators, of so many elements at a time."""
    element = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, number, count = np.unique(element, return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    number, owner = place[number[shared[number]]], owner[shared[number]]
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    out = np.zeros((len(sets), len(sets)), np.int64)
    for a in range(0, int(shared.sum()), columns):
        i, j = np.searchsorted(number, [a, a + columns])
        has = np.zeros((len(sets), columns), np.float32)
        has[owner[i:j], number[i:j] - a] = 1
        out += (has @ has.T).astype(np.int64)
    return out


def counters(batches):
    """How often the sets of a task have a shingle of each counter."""
    total = np.zeros(1 << COUNTERS, np.int64)
    for batch in small_batches(batches, "text"):
        every = np.concatenate([np.zeros(0, np.uint64), *shingle_sets(batch.column("text"))])
        total += np.bincount((every >> U(64 - COUNTERS)).astype(np.int64), minlength=len(total))
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["counter", "n"])


def prefixes(batches, often: np.ndarray, percent: int):
    """The rarest shingles of each set, so many that two similar sets share one of theirs, with their places in that order."""
    for batch in small_batches(batches, "text"):
        row, root = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row_id", "root"))
        sets = shingle_sets(batch.column("text"))
        n = np.array([len(x) for x in sets], np.int64)
        most = n - (n * percent + 99) // 100 + 1
        most[n == 0] = 0
        first = [x[np.lexsort((x, often[(x >> U(64 - COUNTERS)).astype(np.int64)]))[:k]] for x, k in zip(sets, most.tolist(), strict=True)]
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(k) for k in most.tolist())])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.zeros(0, np.uint64), *first]).view(np.int64)), pa.array(np.repeat(row, most)),
             pa.array(np.repeat(root, most)), pa.array(np.repeat(n, most)), pa.array(place)], names=["shingle", "row_id", "root", "n", "place"])


def met_by_rare(members: DataFrame, texts: DataFrame, percent: int, rare: int = RARE) -> tuple[DataFrame, DataFrame]:
    """(pairs, hot): pairs (a, ra, b, rb, most) of members of different roots whose sets can be similar, and the row_id
    of members that a shingle of more than ``rare`` sets leads to others; two similar sets are a pair, or both hot.

    Of two similar sets, the rarest n - ceil(n * percent / 100) + 1 shingles of each have one in common. At the first
    such one, what is left behind it on either side bounds the intersection (most).
    """
    rows = members.select("row_id", "root").distinct().join(texts.select("row_id", "text"), "row_id")
    counts = rows.select("text").mapInArrow(counters, "counter bigint, n bigint").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(1 << COUNTERS, np.int64)
    often[counts.column("counter").to_numpy()] = counts.column("n").to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast(often)
    placed = stage(rows.select("row_id", "root", "text").mapInArrow(lambda b: prefixes(b, shared.value, percent),
                                                                    "shingle bigint, row_id bigint, root bigint, n bigint, place bigint"))
    meets = stage(placed.groupBy("shingle").agg(F.count(F.lit(1)).alias("c"), F.min("root").alias("low"), F.max("root").alias("high"))
                  .filter("low != high").select("shingle", (F.col("c") > rare).alias("hot")))
    hot = stage(placed.join(meets.filter("hot"), "shingle", "left_semi").select("row_id").distinct())
    cold = stage(placed.join(meets.filter("NOT hot"), "shingle", "left_semi"))
    one = cold.select("shingle", F.col("row_id").alias("a"), F.col("root").alias("ra"), F.col("n").alias("an"), F.col("place").alias("ap"))
    two = cold.select("shingle", F.col("row_id").alias("b"), F.col("root").alias("rb"), F.col("n").alias("bn"), F.col("place").alias("bp"))
    most = F.least(F.col("an") - F.col("ap"), F.col("bn") - F.col("bp"))
    pairs = (one.join(two, "shingle").filter((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & fits("an", "bn", percent))
             .filter(most * (100 + percent) >= (F.col("an") + F.col("bn")) * percent)
             .groupBy("a", "ra", "b", "rb").agg(F.max(most / (F.col("an") + F.col("bn"))).alias("most")))
    return stage(pairs), hot


def links_by_rare(pairs: DataFrame, links: DataFrame, texts: DataFrame, percent: int, group: int) -> tuple[DataFrame, DataFrame]:
    """links with those of pairs, and their components: the likeliest pair of each two roots first, then all pairs that are still apart."""
    ends = (F.least("ra", "rb").alias("low"), F.greatest("ra", "rb").alias("high"))
    best = stage(pairs.groupBy(*ends).agg(F.max(F.struct("most", "a", "b")).alias("best")).select("best.a", "best.b"))
    links = stage(links.union(verified(best, texts, percent, group)))
    roots = stage(components(links))
    top = lambda own, to: roots.select(F.col("node").alias(own), F.col("root").alias(to))
    rest = stage(pairs.join(best, ["a", "b"], "left_anti").join(top("a", "ta"), "a", "left").join(top("b", "tb"), "b", "left")
                 .filter(F.coalesce("ta", "a") != F.coalesce("tb", "b")).select("a", "b"))
    if rest.head(1):
        links = stage(links.union(verified(rest, texts, percent, group)))
        roots = stage(components(links))
    return links, roots


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a number for each row, stored so that later joins on it leave the texts in place."""
    rows = docs.withColumn("row_id", F.monotonically_increasing_id())
    return bucketed(rows, "row_id", partitions(docs))


def rooted(texts: DataFrame, percent: int, group: int, block: int, rare: int) -> DataFrame:
    """row_id, doc_id, n_shingles and root of each row."""
    bands = bands_for(percent)
    sigs = stage(texts.mapInArrow(lambda batches: signatures(batches, bands), "row_id bigint, doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>"))
    full = sigs.filter("n_shingles > 0")
    classes = stage(full.groupBy("d1", "d2").agg(F.min("row_id").alias("rep")))
    firsts = full.join(classes.select(F.col("rep").alias("row_id")), "row_id", "left_semi")
    placed = firsts.select("row_id", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))

    # A leader should be near to as many others as possible: the original of many copies shares
    # more bands with them than they do with one another.
    sizes = stage(placed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"))
    crowded = stage(placed.join(sizes, "key"))
    weight = crowded.groupBy("row_id").agg(F.sum("c").alias("weight"))
    members = stage(crowded.join(weight, "row_id").select("key", "row_id", "n", "weight"))
    tested, links, roots = None, None, None
    for _ in range(ROUNDS):
        if roots is not None:
            members = still_apart(members, roots)
        led = stage(members.groupBy("key").agg(F.max(F.struct("weight", "row_id", "n")).alias("lead"))
                    .select("key", F.col("lead.row_id").alias("a"), F.col("lead.n").alias("an")))
        pairs = (members.join(led, "key").filter((F.col("a") != F.col("row_id")) & fits("n", "an", percent))
                 .select("a", F.col("row_id").alias("b")).distinct())
        pairs = stage(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        found = verified(pairs, texts, percent, group)
        links = stage(found if links is None else links.union(found))
        tested = pairs if tested is None else tested.union(pairs)
        roots = stage(components(links))
        members = stage(members.join(led, "key").filter("row_id != a").select("key", "row_id", "n", "weight"))
    apart = still_apart(members, roots)
    if apart.head(1):
        pairs, hot = met_by_rare(apart, texts, percent, rare)
        if pairs.head(1):
            links, roots = links_by_rare(pairs, links, texts, percent, group)
        if hot.head(1):
            apart = still_apart(members.join(hot, "row_id", "left_semi"), roots)
            extra = stage(links_of_rest(apart, texts, sigs.select("row_id", "bands"), percent, block))
            if extra.head(1):
                roots = stage(components(links.union(extra)))

    rows = (sigs.select("row_id", "doc_id", "n_shingles", "d1", "d2").join(classes, ["d1", "d2"], "left")
            .withColumn("rep", F.when(F.col("n_shingles") > 0, F.col("rep")).otherwise(F.col("row_id")))
            .select("row_id", "doc_id", "n_shingles", "rep"))
    return stage(rows.join(roots, F.col("rep") == F.col("node"), "left").select("row_id", "doc_id", "n_shingles", F.coalesce("root", "rep").alias("root")))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, group: int = GROUP, block: int = BLOCK, rare: int = RARE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs.

    Sets are the distinct runs of five words, A-Z lower-cased; documents with fewer words
    have one, all of them; without words or text none, and these are linked with nothing.
    Rows whose similarity is percent / 100 or more are linked, component_id is the smallest doc_id that
    a row reaches, and kept are the rows that bear it.

    Rows with equal sets (by a 128-bit digest of all of it) are one class from the start. Classes that share a band are compared
    with the band's leader, its most connected member; after ROUNDS such leaders, members that are
    still not connected with all of their band meet where they share one of their rarest shingles. Where
    more than rare sets do, they are compared with all such ones of their band, in blocks, so that no link of
    a shared band is lost; group and block bound what one task compares. A row is a node of its own,
    so a repeated doc_id does not link rows; a null doc_id is passed over in the minimum,
    and where a component has no other, component_id is null and kept true. Further columns
    are ignored; an empty table gives no rows.
    """
    texts = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    rows = rooted(texts, percent, group, block, rare)
    least = stage(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    return rows.join(least, "root").select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT, group: int = GROUP, block: int = BLOCK, rare: int = RARE) -> DataFrame:
    """The rows of docs without those that near_duplicates links with a kept one: of each component
    the row with the smallest doc_id stays (a null one last), of equal ones one row."""
    given = Carried(docs, [])
    texts = numbered(given.rows.select("*", given.col("doc_id").cast("long").alias("doc_id")))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_id")).alias("first")
    kept = stage(rooted(texts.select("row_id", "doc_id", "text"), percent, group, block, rare).groupBy("root").agg(first).select("first.row_id"))
    return given.restored(texts.join(kept, "row_id", "left_semi"))
