"""Sets that leaders leave apart meet by their rarest shingles; against comparing all pairs."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.llm.near_dedup import met_by_rare, near_duplicates, numbered, shingle_sets

SCHEMA = "doc_id long, text string"


def edited(rng, words, share):
    """words with runs of five replaced, until about that share of the shingles differs."""
    words = list(words)
    for _ in range(max(1, round(share * len(words) / 9))):
        i = rng.randrange(len(words) - 5)
        words[i:i + 5] = [f"x{rng.randrange(10**9)}" for _ in range(5)]
    return words


def near_limits(n=90, seed=3):
    """Edits of edits of three texts, most of them near the limit from one another."""
    rng, texts = random.Random(seed), []
    for _ in range(3):
        family = [[f"w{rng.randrange(500)}" for _ in range(120)]]
        while len(family) < n // 3:
            family.append(edited(rng, rng.choice(family), rng.choice([0.02, 0.05, 0.08, 0.12])))
        texts += family
    return [" ".join(t) for t in texts]


def similar_pairs(texts, percent):
    sets = [set(x.tolist()) for x in shingle_sets(pa.array(texts))]
    return {(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if 100 * len(a & b) >= percent * len(a | b)}


@pytest.fixture(scope="module")
def limits(spark):
    texts = near_limits()
    return texts, numbered(spark.createDataFrame(list(enumerate(texts)), SCHEMA))


@pytest.mark.parametrize(("percent", "rare"), [(80, 64), (85, 64), (85, 2), (80, 0)])
def test_no_similar_pair_is_missed(limits, percent, rare):
    texts, rows = limits
    ids = {r.row_id: r.doc_id for r in rows.select("row_id", "doc_id").collect()}
    pairs, hot = met_by_rare(rows.select("row_id", F.col("row_id").alias("root")), rows, percent, rare)
    met = {tuple(sorted((ids[r.a], ids[r.b]))) for r in pairs.collect()}
    hot = {ids[r.row_id] for r in hot.collect()}
    want = similar_pairs(texts, percent)
    assert len(want) > 40 and all((i, j) in met or (i in hot and j in hot) for i, j in want)
    if rare == 64:
        assert not hot and len(met) < len(texts) * (len(texts) - 1) / 4  # most pairs that cannot be similar do not meet
    if rare == 0:
        assert not met


@pytest.mark.parametrize("rare", [0, 3, 64])
def test_components_near_the_limit(limits, spark, rare):
    texts, _ = limits
    root = list(range(len(texts)))
    for i, j in sorted(similar_pairs(texts, 85)) * 4:
        low = min(root[i], root[j])
        root = [low if r in (root[i], root[j]) else r for r in root]
    got = near_duplicates(spark.createDataFrame(list(enumerate(texts)), SCHEMA), 85, rare=rare, block=8)
    assert {r.doc_id: r.component_id for r in got.collect()} == dict(enumerate(root))


def test_boilerplate_does_not_meet(spark):
    """Pages alike to three quarters (similarity 0.6) share no rare shingle, so none meets another."""
    rng = random.Random(9)
    common = [f"w{k}" for k in range(150)]
    texts = [" ".join(common + [f"x{rng.randrange(10**12)}" for _ in range(50)]) for _ in range(1500)]
    rows = numbered(spark.createDataFrame(list(enumerate(texts)), SCHEMA))
    pairs, hot = met_by_rare(rows.select("row_id", F.col("row_id").alias("root")), rows, 85)
    assert pairs.count() == 0 and hot.count() == 0


def test_members_without_shingles_or_rows(spark):
    rows = numbered(spark.createDataFrame([(1, None), (2, ""), (3, "one word"), (3, "one word"), (None, "ONE word")], SCHEMA))
    own = rows.select("row_id", F.col("row_id").alias("root"))
    pairs, hot = met_by_rare(own, rows, 85)
    assert pairs.count() == 3 and hot.count() == 0
    pairs, hot = met_by_rare(own.filter("row_id < 0"), rows, 85)
    assert pairs.count() == 0 and hot.count() == 0
