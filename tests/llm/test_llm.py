"""Each operator against a plain version of itself, over tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tickloom.llm import language, quality
from tickloom.llm.decontaminate import decontaminate
from tickloom.llm.exact_dedup import exact_dedup
from tickloom.llm.line_dedup import remove_repeated_lines
from tickloom.llm.mixing import mix_sources
from tickloom.llm.near_dedup import drop_near_duplicates, near_duplicates, superminhash
from tickloom.llm.repeats import remove_repeats
from tickloom.llm.token_files import token_files
from tickloom.llm.url_filter import url_filter

R = random.Random(3)
VOCABULARY = [f"w{i}" for i in range(400)]
LONG = " ".join(R.choice(VOCABULARY) for _ in range(30_000))
BASE = " ".join(R.choice(VOCABULARY) for _ in range(200))
PASSAGE = " ".join(R.choice(VOCABULARY) for _ in range(60))


def near(text, changes):
    words = text.split()
    for _ in range(changes):
        words[R.randrange(len(words))] = "changed"
    return " ".join(words)


TEXTS = [None, "", " ", "one", "One", BASE, BASE.upper(), near(BASE, 1), near(BASE, 3), near(BASE, 12), LONG, LONG, "A\nB\nC\nD\nE", "x\nA\nB\nC\nD\nE\ny", "\n\n\n",
         f"start {PASSAGE} end", f"{PASSAGE} other end", "aaaa" * 100, "é" * 120, *[" ".join(R.choice(VOCABULARY) for _ in range(30)) for _ in range(10)]]
ROWS = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, 1) for i, t in enumerate(TEXTS)]
SCHEMA = "doc_id long, text string, lang string, source string, row_id long"  # row_id clashes with a name that operators use


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_odd_tables(spark, docs):
    """Null ids, repeated rows and no rows: every operator gives a row for each row."""
    odd = docs.union(docs.limit(5)).union(spark.createDataFrame([(None, "x", None, None, None), (None, None, None, None, None)], SCHEMA))
    bench = spark.createDataFrame([(None, None), (1, ""), (1, "w1 w2")], "item_id long, text string")
    for table in (odd, docs.limit(0)):
        n = table.count()
        for f in (exact_dedup, near_duplicates, remove_repeats, remove_repeated_lines, lambda d: decontaminate(d, bench)):
            assert f(table).count() == n
        mixed = [(r.n_copies, r.copy) for r in mix_sources(table).collect()]
        assert sum(c for c, k in mixed if k == 0) == len(mixed) and bool(mixed) == bool(n)
        assert drop_near_duplicates(table).columns == table.columns


def test_rows_without_a_key_draw_alike_wherever_they_are(spark):
    """However the rows are dealt to partitions, as after a lost executor, the same ones are copied as often."""
    docs = spark.createDataFrame([(None if i % 2 else i, f"text {i}", "en", f"s{i % 2}", 1) for i in range(200)], SCHEMA)
    runs = [sorted((r.text, r.n_copies, r.copy, r.shuffle_key) for r in mix_sources(docs.repartition(n)).collect()) for n in (1, 7)]
    assert runs[0] == runs[1] and 100 < len(runs[0]) < 300


def test_exact(docs):
    groups = {}
    for i, t in enumerate(TEXTS):
        groups.setdefault("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""), []).append(i)
    want = [(i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g]
    assert rows(exact_dedup(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=str)


def test_repeats(docs):
    seen, want = set(), []
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if raw[p:p + 100] in seen:
                gone[p:p + 100] = b"\1" * 100
            seen.add(raw[p:p + 100])
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        want.append((i, len(raw), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    assert rows(remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=str)


def test_repeats_split_hot_anchors(docs):
    cols = ("doc_id", "n_removed", "n_spans", "kept_sha256")
    assert rows(remove_repeats(docs, group=1), *cols) == rows(remove_repeats(docs), *cols)


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize(("percent", "sizes"), [(80, {}), (85, {}), (80, {"group": 1, "block": 1})])
def test_near(docs, percent, sizes):
    sets, root = [shingles(t) for t in TEXTS], list(range(len(TEXTS)))
    for _ in TEXTS:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    assert rows(near_duplicates(docs, percent, **sizes), "doc_id", "n_shingles", "component_id", "kept") == sorted([(i, len(s), r, i == r) for i, (s, r) in enumerate(zip(sets, root, strict=True))], key=str)
    assert rows(drop_near_duplicates(docs, percent, **sizes), "doc_id") == sorted([(r,) for r in set(root)], key=str)


def test_superminhash_estimates():
    r = np.random.default_rng(1)
    both, a, b = (r.integers(0, 2**63, n, dtype=np.uint64) for n in (600, 100, 100))
    sig = superminhash([np.unique(np.concatenate([both, a])), np.unique(np.concatenate([both, b])), both[:3]], 140)
    assert np.isfinite(sig).all() and abs((sig[0] == sig[1]).mean() - 0.75) < 0.12


def test_decontaminate(spark, docs):
    items = [(5, " ".join(PASSAGE.split()[3:40])), (10, "one"), (7, " ".join(BASE.split()[:13])), (8, "Not there at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    import regex

    words = lambda t: regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    want = []
    for i, t in enumerate(TEXTS):
        w, hit, found = words(t), set(), set()
        for item, text in items:
            b = words(text)
            m = min(13, len(b))
            wins = {tuple(b[k:k + m]) for k in range(len(b) - m + 1)}
            for k in range(len(w) - m + 1):
                if tuple(w[k:k + m]) in wins:
                    hit |= set(range(k, k + m))
                    found.add(str(item))
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows(decontaminate(docs, bench), *cols) == sorted(want, key=str)
    assert rows(decontaminate(docs, bench, block_bytes=100), *cols) == sorted(want, key=str)


def test_token_files_round_trip(docs):
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = tokenizers.path("word_bpe_49k.json")
    t, want, start = Tokenizer.from_file(path), [], 0
    for i, text in enumerate(TEXTS):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert rows(token_files(docs, path), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=str)


def test_mixing_rates(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id < 3000 THEN 'a' ELSE 'b' END AS source")
    n = {r.source: r["count"] for r in mix_sources(df, {"a": 1.0, "b": 3.0}, total=4000).groupBy("source").count().collect()}
    assert abs(n["a"] - 1000) < 150 and abs(n["b"] - 3000) < 250
    few = spark.createDataFrame([(1, "a")], "doc_id long, source string")
    assert abs(mix_sources(few, total=10_000).count() - 10_000) < 500


def test_lines_repeat(docs):
    got = {r.doc_id: r for r in remove_repeated_lines(docs).collect()}
    assert got[12].n_removed == 0 and got[13].n_removed == 5 and got[13].text == "x\ny" and got[0].n_lines == 1 and got[14].n_removed == 0


def test_url_rules(spark):
    urls = ["http://A.Example.COM/en/7x?q", "https://x.com/en/1", "http://example.net/de/8", "http://other.net/de/8#t", "http://a.org/es/", "no url", None, "http://com/en/", "ftp://h"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(8, 1), (None, 1), (99, 0)], "page_id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter(pages, labels).collect()}
    assert got[0] == ("a.example.com", "/en/7x", "example.com/en/7", "allow") and got[1][2:] == ("com/en/", "block") and got[2][2:] == ("example.net/de/8", "block")
    assert got[3][2:] == ("net/de/", "allow") and got[4][2:] == ("org/es/", "block") and got[5][:3] == ("", "", None) and got[6][:3] == ("", "", None) and got[8][:3] == ("h", "", None)


def test_models_on_held_out_rows(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    lang = entry.queries()["op8_language_id"](spark, sf).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert lang.filter("lang = lang_pred").count() >= 0.95 * lang.count()
    q = entry.queries()["op10_quality"](spark, sf).filter("held_out").join(labels, "doc_id")
    assert q.filter("predicted = quality").count() >= 0.9 * q.count()
    odd = spark.createDataFrame(ROWS, SCHEMA).limit(4)
    assert quality.quality_scores(odd, quality.fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0))).filter("score = 0.5").count() == 4
    assert {r.lang_pred for r in language.identify(odd.limit(3), language.train(odd.limit(0))).collect()} == {"und"}
