"""The pipeline's stages against plain versions over the smallest tables, and line dedup against its rule."""

import random
from collections import Counter

import pytest
from test_llm import shingles

import corpus_pipeline as cp
from tickloom.llm.common import stage
from tickloom.llm.line_dedup import remove_repeated_lines
from tickloom.llm.queries import op10_quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """What each stage is given and returns."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, function in cp.STAGES:
        after = stage(function(spark, docs, SF))
        out.append((docs, after))
        docs = after
    return out


def test_columns_and_whole_texts(steps):
    for before, after in steps[:-1]:
        assert sorted(after.columns) == ["doc_id", "lang", "n_chars", "source", "text"]
        texts = {r.doc_id: r.text for r in before.collect()}
        assert all(texts[r.doc_id] == r.text for r in after.collect())


def test_quality_keeps_what_it_accepts(spark, steps):
    want = sorted(r.doc_id for r in op10_quality(spark, SF).filter("predicted = 1").collect())
    assert sorted(r.doc_id for r in steps[0][1].collect()) == want


def test_one_of_each_group(steps):
    before, after = steps[1]
    sets = sorted((r.doc_id, shingles(r.text)) for r in before.collect())
    root = {d: d for d, _ in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((top(a), top(b)))
                root[q] = p
    groups = Counter(top(r.doc_id) for r in after.collect())
    assert set(groups) == {top(d) for d in root} and set(groups.values()) == {1}


def test_mixing_covers_each_source(steps):
    before, after = steps[3]
    n, sources = before.count(), before.select("source").distinct().count()
    counts = {r.source: r["count"] for r in after.groupBy("source").count().collect()}
    assert all(abs(c - n / sources) < 6 * (n / sources) ** 0.5 for c in counts.values())


def test_tokens_of_every_copy(steps):
    before, after = steps[4]
    assert Counter(r.doc_id for r in before.collect()) == Counter(r.doc_id for r in after.collect())
    at = 0
    for r in sorted(after.collect(), key=lambda r: (r.start, r.n_tokens)):
        assert r.start == at
        at += r.n_tokens


@pytest.mark.parametrize("seed", range(2))
def test_line_runs(spark, seed):
    """Each of these lines has a window's words: every one that stands in an earlier text goes, and no other."""
    r = random.Random(seed)
    passages = [[f"p{i} line {k}" for k in range(1 + i % 4)] for i in range(6)]
    texts = []
    for i in range(40):
        lines = [f"own {i} {k}" for k in range(r.randrange(5))]
        for _ in range(r.randrange(3)):
            lines += r.choice(passages) + [f"more {i} {r.random()}"]
        texts.append("\n".join(lines))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    grams = lambda t: {(x,) for x in t}
    kept = {row.doc_id: row.text.split("\n") for row in remove_repeated_lines(docs).collect()}
    seen, seen_lines = set(), Counter()
    for i, text in enumerate(texts):
        lines = text.split("\n")
        gone = Counter(lines) - Counter(kept[i])
        assert not any(x.startswith(("own", "more")) for x in gone)
        for p in passages:
            if any(lines[k:k + len(p)] == p for k in range(len(lines))) and grams(p) <= seen:
                inner = p
                assert all(gone[x] == lines.count(x) for x in inner)
        seen |= grams(lines)
        seen_lines.update(lines)
        assert all(seen_lines[x] > 1 for x in gone)
