"""Columns whose names operators use themselves, page templates, and models and hashes against plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.llm import language, quality, repeats
from tickloom.llm import url_filter as urls
from tickloom.llm.common import _OPEN, partitions, stage, staged_until_end
from tickloom.llm.decontaminate import Searcher, decontaminate
from tickloom.llm.exact_dedup import exact_dedup
from tickloom.llm.line_dedup import remove_repeated_lines
from tickloom.llm.mixing import mix_sources
from tickloom.llm.near_dedup import drop_near_duplicates, near_duplicates
from tickloom.llm.queries import tokenizer_path
from tickloom.llm.token_files import token_files

NAMES = ["s", "k", "draws", "_draws", "table", "_table", "block", "_block", "given", "row", "c0", "c1", "row_id", "spans", "_spans", "begins", "ends", "root", "node", "gram", "key", "rep",
         "h", "g", "first", "last", "t", "chunk", "recipe", "x.y", "with `tick"]
RESULTS = ["Score", "PREDICTED", "Lang_Pred", "N_words", "Items", "Copy", "N_copies", "Shuffle_Key", "Contaminated"]
TEXTS = ["one two three four five six", "one two three four five six", None, "", "seven eight"]
TREES = quality.fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0))
ADDERS = {"quality": (lambda d: quality.quality_scores(d, TREES), {"score", "predicted"}), "language": (lambda d: language.identify(d, language.Network.new(["x"])), {"lang_pred", "score"}),
          "decontaminate": (lambda d: decontaminate(d, d.select(F.lit(1).alias("item_id"), "text")), {"n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated"}),
          "blocks": (lambda d: decontaminate(d, d.select(F.lit(1).alias("item_id"), "text"), block_bytes=10), {"n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated"}),
          "mix": (lambda d: mix_sources(d), {"n_copies", "copy", "shuffle_key"}), "near": (lambda d: drop_near_duplicates(d), set())}


@pytest.fixture(scope="module")
def named(spark):
    """One column of every name, with the row's number as value."""
    cols = [*NAMES, *RESULTS]
    rows = [(i, t, "src", *[i] * len(cols)) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c.replace('`', '``')}` long" for c in cols)).repartition(2)


@pytest.mark.parametrize("name", ADDERS)
def test_names_that_clash(named, name):
    function, added = ADDERS[name]
    out = function(named)
    kept = [c for c in named.columns if c.lower() not in added]
    assert out.columns == [*kept, *[c for c in out.columns if c not in kept]] and {c.lower() for c in out.columns[len(kept):]} == added
    for r in out.collect():
        assert r[0] is not None and r[1] == TEXTS[r[0]] and all(r[i] == r[0] for i in range(3, len(kept)))


def test_names_that_are_ignored(named):
    for f in (near_duplicates, exact_dedup, remove_repeated_lines, repeats.remove_repeats, lambda d: token_files(d, tokenizer_path())):
        assert f(named).count() == len(TEXTS)


def plain_template(paths, labels):
    """Templates of one host's shapes, by walking its tree; labels: (labelled, bad) of each."""
    out = {}

    def walk(prefix, members, level):
        kids = {}
        for m in members:
            kids.setdefault(m[level] if level < len(m) else "", []).append(m)
        total = lambda ms: tuple(sum(labels[m][k] for m in ms) for k in (0, 1))
        lab, bad = total(members)
        p, below = bad / max(lab, 1), {}
        for seg, ms in kids.items():
            n, b = total(ms)
            alike = n == 0 or (b / max(n, 1) - p) ** 2 * n <= urls.SIMILAR_Z**2 * p * (1 - p)
            to = "*" if seg and alike and (len(kids) > urls.MAX_CHILDREN or (len(kids) > 1 and n > 0)) else seg
            below.setdefault(prefix + "/" + to, []).extend(ms)
        for to, ms in below.items():
            over = [m for m in ms if level >= len(m)]
            out.update((m, to) for m in over)
            if len(over) < len(ms):
                walk(to, [m for m in ms if level < len(m)], level + 1)

    walk("", paths, 0)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_templates(spark, seed):
    r = random.Random(seed)
    paths = sorted({tuple(r.choice(["a", "b", "c", f"v{r.randrange(60)}"]) for _ in range(r.randrange(1, 9))) for _ in range(120)})
    labels = {p: (r.choice([0, 0, 1, 3]), 0) for p in paths}
    labels = {p: (n, n if p[0] == "a" and r.random() < 0.9 else 0) for p, (n, _) in labels.items()}
    shapes = spark.createDataFrame([("h", list(p), float(labels[p][0]), float(labels[p][1])) for p in paths], "host string, shape array<string>, lab double, bad double")
    got = {tuple(x.shape): x.template for x in urls.template_tree(shapes).collect()}
    assert got == plain_template(paths, labels) and any("*" in t for t in got.values())


def test_templates_of_long_equal_paths(spark, monkeypatch):
    """Hundreds of equal segments are passed at once; stars of the urls themselves and empty segments fare as in the plain walk."""
    rounds, kept = [], urls.stage
    monkeypatch.setattr(urls, "stage", lambda df: rounds.append(1) or kept(df))
    trap = ("loop",) * 800  # the plain walk calls itself once a segment
    paths = sorted({(*trap, x, *y) for x in "ab" for y in ((), ("",), ("", "c"), ("*",), ("*", "d"), ("p", "q"), ("p", "q", "r"))} | {("*", "u", str(i)) for i in range(3)} | {("",), ("", "")})
    labels = {p: (2 * (i % 3), 2 * (i % 3) if "a" in p else 0) for i, p in enumerate(paths)}
    shapes = spark.createDataFrame([("h", list(p), float(labels[p][0]), float(labels[p][1])) for p in paths], "host string, shape array<string>, lab double, bad double")
    got = {tuple(x.shape): x.template for x in urls.template_tree(shapes).collect()}
    assert got == plain_template(paths, labels) and len(rounds) < 10


def test_templates_are_rejected_by_their_labels(spark):
    """Pages of a bad place go, labelled or not; those of a good place stay; deep paths are generalised too."""
    names = [x + y for x in "abcdef" for y in "abcdefg"]
    pages_ = [f"http://x.com/a/b/c/d/e/{k}/{i}" for k in ("good", "bad") for i in names] + [f"http://y{i}.org/z" for i in range(30)]
    pages = spark.createDataFrame(list(enumerate(pages_)), "page_id long, url string")
    marks = spark.createDataFrame([(i, int("bad" in u)) for i, u in enumerate(pages_) if i % 3 == 0], "page_id long, bad int")
    got = {r.page_id: (r.verdict, r.template) for r in urls.url_filter(pages, marks, rules=[]).collect()}
    assert all(got[i][0] == ("block" if "bad" in u else "allow") for i, u in enumerate(pages_))
    assert {t for v, t in got.values() if v == "block"} == {"/a/b/c/d/e/bad/*/"}


def test_evidence(spark):
    rows = [(1, "http://my.casino-x.com/", "<p>a b</p>"), (2, "http://casinos.com/", "<p|>a b</p>"), (3, "http://a.b", "x | y | z | u"), (4, None, "x"), (5, "http://pills.org", None)]
    got = urls.evidence(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.bad for r in got.collect()} == {1: 1, 2: 0, 3: 1, 4: 0, 5: 1}


def test_equal_identifiers_of_other_chunks(spark):
    texts = ["abc", "abd", "ABC", "x" * 5000 + "a ", "y" * 5000 + "a ", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(exact_dedup(docs, identifier=lambda c: F.length(c).cast("long"))) == rows(exact_dedup(docs))


def test_parts_of_a_long_text(spark, monkeypatch):
    r = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    shared = " ".join(r.choices(words, k=200))
    texts = [" ".join(r.choices(words, k=3000)) + shared + " ".join(r.choices(words, k=500)), "a" * 4000, shared, "b" + "a" * 150]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = lambda: sorted(tuple(x) for x in repeats.remove_repeats(docs).drop("text").collect())
    whole = rows()
    small = lambda batches, column, most=0: (b.slice(i, 1) for b in batches for i in range(b.num_rows))
    monkeypatch.setattr(repeats, "PART", 1000)
    monkeypatch.setattr(repeats, "small_batches", small)
    docs_of = lambda batches: list(repeats.find_anchors(batches))
    batch = pa.RecordBatch.from_pydict({"row_id": pa.array(range(4)), "doc_id": pa.array(range(4)), "text": texts})
    cut = pa.Table.from_batches(docs_of([batch]))
    assert cut.num_rows > 4 and max(cut["last"].to_pylist()) > 3000
    starts = set()
    for x in cut.filter(pa.compute.invert(cut["done"])).to_pylist():
        starts |= {(x["doc_id"], p) for p in range(x["first"], x["last"] + 1)}
    covered = {(i, p) for i, p in starts}
    for x in cut.filter(cut["done"]).to_pylist():
        covered |= {(x["doc_id"], p) for p in range(x["first"], x["last"] - 99)}
    assert covered == {(i, p) for i, t in enumerate(texts) for p in range(len(t) - 99)}
    assert dict((x[0], x[2]) for x in whole)[2] == len(shared)


def test_network_by_hand():
    """Probabilities from the sums over each window, filter and byte, one by one."""
    net = language.Network.new(["a", "b", "c"], seed=3)
    net.bias += 0.1
    x = np.random.default_rng(1).integers(0, 256, (5, language.WINDOW), dtype=np.uint8)
    for row, got in zip(x, net.predict(x), strict=True):
        pooled = []
        for w, f in zip(language.WIDTHS, net.filters, strict=True):
            pooled += [max(sum(float(net.embed[row[t + k]] @ f[k][:, j]) for k in range(w)) for t in range(language.WINDOW - w + 1)) for j in range(language.FILTERS)]
        z = np.maximum(np.array(pooled) + net.bias, 0) @ net.out + net.out_bias
        assert np.allclose(np.exp(z) / np.exp(z).sum(), got, atol=1e-4)


def test_trees_by_hand():
    """Scores by walking each tree for each row."""
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 4))
    model = quality.fit(x, ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float))
    for row, got in zip(x, model.score(x), strict=True):
        total = model.base
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += leaf[node - len(f)]
        assert got == pytest.approx(1 / (1 + np.exp(-total)))
    assert ((model.score(x) > 0.5) == ((x[:, 0] > 0) ^ (x[:, 1] > 0.5))).mean() > 0.95


def test_labels_that_contradict(spark):
    docs = spark.createDataFrame([(i, "word " * i) for i in range(8)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i in range(8) for q in (0, 1, int(i > 3))], "doc_id long, quality int")
    a, b = (quality.train(docs, labels.repartition(n)) for n in (1, 5))
    assert np.array_equal(a.leaf, b.leaf) and a.base == b.base


def test_shift_table_at_scale():
    """A large benchmark: most places are skipped, and the tables stay a small multiple of the text."""
    r = random.Random(1)
    words = ["".join(r.choices("abcdefghijklmnop", k=6)) for _ in range(20_000)]
    items = [(str(i), " ".join(r.choices(words, k=400))) for i in range(300)]
    s = Searcher.build(items)
    text = sum(len(t) for _, t in items)
    arrays = [*vars(s.bench).values(), *(v for t in s.tables for v in vars(t).values() if isinstance(v, np.ndarray))]
    assert sum(a.nbytes for a in arrays) < 12 * text
    table = s.tables[-1]
    assert table.shift.mean() > 9


def test_partitions_follow_the_files(spark, monkeypatch):
    from tickloom.llm import common

    df = stage(spark.range(10_000))
    few = partitions(df)
    monkeypatch.setattr(common, "PART_BYTES", 1000)
    assert few == int(spark.conf.get("spark.sql.shuffle.partitions")) < partitions(df) <= 100


def test_staged_data_goes(spark):
    with staged_until_end(spark):
        df = stage(spark.range(5))
        path = _OPEN[-1][0]
        assert spark.read.parquet(path).count() == df.count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_buckets_beyond_the_limit(spark, monkeypatch):
    """One file a bucket, and joins on the key still leave the rows in place."""
    from tickloom.llm import common

    monkeypatch.setattr(common, "MOST_BUCKETS", 2)
    df = common.bucketed(spark.range(0, 1000, 1, 6).withColumnRenamed("id", "k"), "k", 4)
    assert len(df.inputFiles()) == 4 and df.count() == 1000
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = df.join(spark.range(500).withColumnRenamed("id", "k"), "k")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1
