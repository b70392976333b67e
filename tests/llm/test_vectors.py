"""Hard negatives and top-k search against plain loops, over tables with nulls, ties, repeated rows and vectors of other lengths."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.llm import topk_search, vectors
from tickloom.llm.hard_negatives import balanced, hard_negatives, primes_for, product_residues, reconstruct, residues
from tickloom.llm.topk_search import Search, top_k

SCHEMA = "vec_id long, embedding array<float>, label int, id string, row string, score string"


def odd_rows(seed, n=300, dim=6):
    """A third are one vector; some have no id, label, vector or component, other lengths, or come again."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        v = [r.choice([-1.5, -0.25, 0.1, 0.5, 2.0]) for _ in range(dim)] if i % 3 else [0.5] * dim
        v = {7: None, 17: [], 27: v[:3], 37: [*v, 1.0], 47: [math.nan, 1.0], 57: [None, 1.0], 67: [math.inf]}.get(i, v)
        rows.append((None if i in (11, 12) else i, v, None if i == 13 else r.randrange(3), "x", "y", "z"))
    return [*rows, *rows[:1], *rows[100:103], *rows[20:24]]


def plain(rows, scale, label):
    """row number, id, label, integers of those that take part."""
    out = []
    for n, (i, v, lab, *_) in enumerate(rows):
        if v is None or any(x is None or not math.isfinite(x) for x in v) or (label and lab is None):
            continue
        out.append((n, i, lab, [math.floor(scale * float(np.float32(x))) for x in v]))
    return out


def ranked(q, rows):
    """Score, id and label of the others, the best first."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    return sorted(((dot(q[3], c[3]), c[1], c[2]) for c in rows if c[0] != q[0]), key=lambda t: (-t[0], t[1] is None, t[1] or 0))


def plain_top(rows, k, scale):
    held = plain(rows, scale, False)
    return [(q[1], r, i, s) for q in held if q[1] is not None and q[1] % 100 == 0 for r, (s, i, _) in enumerate(ranked(q, held)[:k], 1)]


def plain_negatives(rows):
    held, out = plain(rows, 256, True), []
    for q in held:
        if q[1] is None or q[1] % 100:
            continue
        order = ranked(q, held)
        for ps, pid, _ in [x for x in order if x[2] == q[2]][:5]:
            fits = [x for x in order if x[2] != q[2] and 30 * ps <= 100 * x[0] <= 90 * ps]
            out += [(q[1], pid, r, nid, ps, ns) for r, (ns, nid, _) in enumerate(fits[:10], 1)]
    return out


def listed(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("cells", [False, True])
def test_against_plain_loops(spark, monkeypatch, seed, cells):
    rows = odd_rows(seed)
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if cells:  # one query a group, some pieces
        monkeypatch.setattr(vectors, "QUERY_BYTES", 60)
        monkeypatch.setattr(vectors, "PIECE_BYTES", 4000)
    assert listed(top_k(table)) == sorted(plain_top(rows, 10, 1024), key=str)
    got = listed(hard_negatives(table))
    assert got == sorted(plain_negatives(rows), key=str) and len(got) > 50


def test_no_rows_and_few(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert top_k(none).columns == ["query_id", "rank", "vec_id", "score"] and top_k(none).count() == 0
    assert hard_negatives(none).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and hard_negatives(none).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.5, 9.0], 1), (2, [0.25, 1.0], 2), (3, [-1.0, 0.0], 2)], "vec_id long, embedding array<double>, label long")
    assert listed(top_k(few, scale=4)) == [(0, 1, 1, 8), (0, 2, 2, 4), (0, 3, 3, -16)]
    assert listed(hard_negatives(few, scale=4)) == [(0, 1, 1, 2, 8, 4)]
    assert top_k(few, queries="id = 9").count() == 0


def test_labels_of_any_type_and_other_parameters(spark):
    few = spark.createDataFrame([(1, [3.0], "a"), (2, [2.0], "a"), (3, [1.0], "b"), (4, [2.0], "c")], "k int, v array<float>, topic string")
    got = hard_negatives(few, anchors="id = 1", low=50, high=100, scale=1, key="k", vector="v", label=F.upper("topic"))
    assert listed(got) == [(1, 2, 1, 4, 6, 6), (1, 2, 2, 3, 6, 3)]


def test_large_components(spark):
    """Beyond what float64 holds exactly; beyond 64 bits."""
    r = random.Random(5)
    rows = [(i, [float(r.randrange(-2**29, 2**29)) for _ in range(5)], i % 2, "", "", "") for i in range(40)]
    table = spark.createDataFrame(rows, SCHEMA.replace("float", "double"))
    dot = lambda a, b: sum(int(x) * int(y) for x, y in zip(rows[a][1], rows[b][1], strict=True))
    want = sorted((-dot(0, i), i) for i in range(1, 40))[:10]
    assert [(x.vec_id, x.score) for x in top_k(table, scale=1).orderBy("rank").collect()] == [(i, -s) for s, i in want]
    same, others = sorted((-dot(0, i), i) for i in range(2, 40, 2))[:5], sorted((-dot(0, i), i) for i in range(1, 40, 2))
    fits = [(i, -s, j, -t) for s, i in same for t, j in others if 30 * -s <= 100 * -t <= 90 * -s]
    assert {(x.positive_id, x.positive_score, x.negative_id, x.negative_score) for x in hard_negatives(table, scale=1).collect()} == set(fits) and len(fits) > 3
    for f in (top_k, hard_negatives):
        with pytest.raises(OverflowError):
            f(table, scale=1 << 10)


@pytest.mark.parametrize("largest", [1, 200, 2**20, 2**25])
@pytest.mark.parametrize("depth", [0, 1, 64, 3000])
def test_residue_products(largest, depth):
    rng = np.random.default_rng(largest + depth)
    a, b = rng.integers(-largest, largest + 1, (7, depth)), rng.integers(-largest, largest + 1, (9, depth))
    bound = max(1, depth) * largest**2
    primes = primes_for(bound)
    want = np.array([[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a])
    assert (reconstruct(product_residues(residues(a, primes), residues(b, primes), primes), primes) == want).all()
    assert math.prod(primes) > 2 * bound and (len(primes) == 1 or math.prod(primes[:-1]) <= 2 * bound)


def test_extreme_residues():
    """Sums of DEPTH equal products of the largest residues, and the largest integers that the moduli tell apart."""
    for p in (251, 197):
        x = np.full((1, 1024), p // 2)
        for sign in (1, -1):
            assert product_residues(residues(x, [p]), residues(sign * x, [p]), [p])[0][0, 0] == balanced(np.array([sign * 1024 * (p // 2) ** 2]), p)[0]
    primes = primes_for(2**63 - 1)
    for v in (2**63 - 1, -(2**63) + 1, 0, 1, -1):
        assert reconstruct([np.array([[(v + p // 2) % p - p // 2]], np.int32) for p in primes], primes)[0, 0] == v


def test_search_stops_early():
    """Rows near one direction: few of a block's entries are read, and few scores resolved."""
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(2048, 16)) * 1000 / (1 + np.arange(2048))[:, None]).astype(np.int64)
    q = (rng.normal(size=(4, 16)) * 1000).astype(np.int64)
    as_lists = lambda m: pa.array(list(m), pa.list_(pa.int64()))
    search = Search(pa.table({"row": np.arange(4) + 10_000, "id": np.arange(4), "vec": as_lists(q)}), 10, 5000)
    search.offer(pa.record_batch({"row": np.arange(2048), "id": np.arange(2048), "vec": as_lists(x), "label": pa.array([""] * 2048)}))
    at, ids, score = search.best.found()
    want = np.sort(q @ x.T, axis=1)[:, :-11:-1]
    assert (score.reshape(4, 10) == want).all() and search.read < 4 * 2048 / 2 and search.resolved < 4 * 2048 * topk_search.FEW + 1
