"""The audit of sources against plain counting; the packed sorts against sorted()."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tickloom.llm import divergence
from tickloom.llm.divergence import Pairs, Terms, counted, merged, radix_order, shares, source_divergence

WORDS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, value string"


def plain(rows, least=30, top=50):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        words = WORDS.findall((text or "").translate(low))
        groups[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang in docs:
        kept = [w for w, n in docs[lang].items() if n >= least]
        sources = [s for la, s in groups if la == lang]
        whole = sum((groups[lang, s] for s in sources), Counter())

        def share(c, kept=kept):
            total = sum(c[w] for w in kept)
            return {w: 1 + 1000000000 * (c[w] + 5) // (total + 5 * len(kept)) for w in kept}

        p, q = {s: share(groups[lang, s]) for s in sources}, share(whole)
        for s in sources:
            pair = [(sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in sources if o != s]
            term = [(p[s][w] - q[w], w) for w in kept if groups[lang, s][w] and p[s][w] > q[w]]
            for part, items in (("pair", pair), ("term", term)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, r) for r, (v, i) in enumerate(items[:top] if part == "term" else items, 1)]
    return sorted(out)


def made(seed, n=260):
    r = random.Random(seed)
    words = ["The", "of", "a", "straße", "été", "日本語の長い言葉です", "eight888bytes", "abcdefgh", "abcdefghi", "sixteenlettersss", "seventeenletterss", "x" * 40, "X" * 39 + "y"] + [f"w{c}" for c in "abcdefghijklmnop"]
    rows = []
    for i in range(n):
        some = r.choices(words, weights=range(len(words), 0, -1), k=r.choice([0, 1, 5, 30]))
        text = {5: None, 6: "", 7: "1 2 -- 3", 8: " ".join(words * 4000)}.get(i, " ".join(w + r.choice(["", "9", ".", "\x00"]) for w in some))
        rows.append((i if i % 50 else None, text, r.choice(["en", "en", "de", None, ""]), r.choice(["web", "web", "web", "book", "é", None]), "t", 1, "v"))
    return [*rows, *rows[:9], (1, None, "zz", "alone", "", 0, ""), (2, "a b", "yy", "one", "", 0, ""), (3, None, "yy", "two", "", 0, "")]


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("small", [False, True])
def test_against_plain_counting(spark, monkeypatch, seed, small):
    if small:  # tasks hand on what they hold, sources come in blocks, terms one after another
        for name, value in (("HELD", 4), ("SOURCES", 2), ("CELLS", 1)):
            monkeypatch.setattr(divergence, name, value)
    rows = made(seed)
    got = sorted(map(tuple, source_divergence(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()))
    assert got == plain(rows) and {g[2] for g in got} == {"pair", "term"}


def test_other_parameters_and_no_rows(spark):
    rows = made(3)
    table = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"text": "body", "lang": "language", "source": "site"})
    got = sorted(map(tuple, source_divergence(table, 2, 3, "body", "language", "site").collect()))
    assert got == plain(rows, 2, 3)
    assert source_divergence(table.limit(0), 2, 3, "body", "language", "site").count() == 0


def test_terms():
    r = random.Random(1)
    words = ["".join(r.choice("ab\xe9") for _ in range(r.randrange(1, 22))).encode() for _ in range(3000)]
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    terms = Terms(data, end - [len(w) for w in words], end)
    assert [words[terms.first[n]] for n in terms.number] == words and len(terms.first) == len(set(words))


def test_radix_order():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 5, 5000).astype(np.uint64), rng.integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2)
    b[::3] = b[0]
    assert (radix_order([a, b]) == np.lexsort((b, a))).all() and (radix_order([b]) == np.argsort(b, kind="stable")).all()
    assert len(radix_order([a[:0]])) == 0 and radix_order([a[:1]]).tolist() == [0]


def test_merged_counts():
    batch = pa.record_batch({"lang": ["l", "l", "m"], "source": ["s", "t", "s"], "text": ["a B a", "b", "a"]})
    table = merged([counted(batch), counted(batch)])
    assert sorted(map(tuple, (d.values() for d in table.to_pylist()))) == [("l", "s", "a", 4, 2), ("l", "s", "b", 2, 2), ("l", "t", "b", 2, 2), ("m", "s", "a", 2, 2)]


def test_shares_of_large_counts():
    n, total = np.array([5, 2**52, 8 * 10**15, 7]), np.array([7, 2**52 + 1, 9 * 10**15 - 1, 7])
    assert shares(n, total).tolist() == [1 + 10**9 * a // b for a, b in zip(n.tolist(), total.tolist(), strict=True)]


def test_pairs_of_no_terms():
    pairs = Pairs("l", 0, [{"source": "a", "n": 0}, {"source": "b", "n": 0}], 0)
    assert [r.to_pylist() for r in pairs.rows()] == [[{"lang": "l", "source": "a", "item": "b", "value": 0}], [{"lang": "l", "source": "b", "item": "a", "value": 0}]]
