"""Token files of texts that are hard to cut, against the tokenizer's plain call."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tickloom.llm import token_files as tf

tokenizers = pytest.importorskip("public_tokenizers")
PATH = tokenizers.path("word_bpe_49k.json")


def plain(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [t.encode(x, add_special_tokens=False).ids for x in texts]


def coded(texts, **options):
    coder = tf.Encoder(PATH, **options)
    return [np.frombuffer(x, coder.dtype).tolist() for x in coder.encode(pa.array(texts, pa.string()))]


def test_texts_without_blanks():
    r = random.Random(5)
    blob = "".join(r.choices("abcdefgh0123456789+/", k=tf.PIECE + 5000))
    words = " ".join(r.choices(["one", "Two,", "three3", "\t", "four."], k=300_000))
    texts = [blob, f"{words} {blob}\n{words}", "short one", f"{blob} end"]
    assert coded(texts) == plain(texts)


@pytest.mark.parametrize("piece", [1, 7, 50])
def test_pieces(monkeypatch, piece):
    monkeypatch.setattr(tf, "PIECE", piece)
    r = random.Random(piece)
    texts = ["".join(r.choices("ab \n.", [5, 5, 1, 1, 1], k=r.randrange(200))) for _ in range(40)]
    assert all(" " not in p for t in texts for p in tf.pieces(t) if len(p) > piece)
    assert all(" ".join(tf.pieces(t)) == t.replace("\n", " ") for t in texts)
    assert coded(texts) == plain(texts)


def test_long_text_clears_words(monkeypatch):
    """A long text may clear the remembered words; those of the texts around it are still known."""
    monkeypatch.setattr(tf, "PIECE", 60)
    monkeypatch.setattr(tf, "CACHE_WORDS", 20)
    texts = ["alpha beta", " ".join(f"w{i}" for i in range(100)), "gamma delta"]
    assert coded(texts) == plain(texts)


MARKED = ["one <|endoftext|> two", "<|startoftext|>One<|endoftext|>two, <|ENDOFTEXT|>", "<|endoftext|>" * 3, "plain"]


def test_special_tokens_in_texts(spark):
    ends = [[*ids, tf.END_ID] for ids in plain(MARKED)]
    assert ends[0] == [637, 49407, 1237, 1] and 49406 in ends[1]
    docs = spark.createDataFrame(list(enumerate(MARKED)), "doc_id long, text string")
    assert [r.ids for r in tf.token_files(docs, PATH, digest=False).orderBy("doc_id").collect()] == ends
    literal = [r.ids for r in tf.token_files(docs, PATH, digest=False, literal_markers=True).orderBy("doc_id").collect()]
    assert literal[0] == [637, 27, 347, 40786, 4160, 91, 285, 1237, 1] and literal[3] == ends[3]


ODD = ["don't", "It's", "ÉCOLE", "e\u0301te\u0301", "İstanbul", "ΣΑΣ", "straße!", "ª", "xº", "a\xa0b", "\u3000", "a\x1cb", "漢字かな", "1st", "a.b", "!!", ".", "\x85", "foo,bar", "\u200b", "ﬁ", "\x00"]


@pytest.mark.parametrize("most", [30, 1_000_000])
def test_odd_words(monkeypatch, most):
    """Words, marks and white space of many kinds, with a cache that holds them and with one that must forget."""
    monkeypatch.setattr(tf, "CACHE_WORDS", most)
    r = random.Random(most)
    blanks = [" ", "\t", "\n", "\r\n", "\x0b", "\x0c", "  ", ""]
    texts = ["".join(r.choice([*ODD, "Plain", "words.", "wo"]) + r.choice(blanks) for _ in range(r.randrange(40))) for _ in range(400)]
    coder = tf.Encoder(PATH)
    got = [np.frombuffer(x, coder.dtype).tolist() for i in range(0, 400, 20) for x in coder.encode(pa.array([*texts[i:i + 20], None], pa.string()))[:-1]]
    assert got == plain(texts)


def test_other_tokenizers():
    """One that keeps white space and case is not cut at blanks."""
    from tokenizers import Tokenizer

    path = tokenizers.path("byte_bpe_50k.json")
    coder, t, texts = tf.Encoder(path), Tokenizer.from_file(path), ["Two  words", " one", "", "\n\n"]
    assert not coder.by_word and tf.cuts_at_blanks(PATH)
    assert [np.frombuffer(x, coder.dtype).tolist() for x in coder.encode(pa.array(texts))] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_many_rows_of_one_key(spark, tmp_path):
    """Rows without doc_id are dealt to several shards, and all come back."""
    docs = spark.createDataFrame([(None, f"text {i}") for i in range(400)] + [(1, "last")], "doc_id long, text string").repartition(3)
    rows = tf.token_files(docs, PATH, path=f"file://{tmp_path}/t", digest=False).orderBy("start").collect()
    shards = spark.read.parquet(f"{tmp_path}/t/blocks").select("shard").distinct().count()
    assert shards > 1 and len(rows) == 401 and rows[-1].doc_id == 1
    assert sorted(r.ids for r in rows) == sorted([*ids, tf.END_ID] for ids in plain([*(f"text {i}" for i in range(400)), "last"]))


def test_several_blocks_a_shard(spark, tmp_path):
    """Starts go on over blocks of one shard and over shards; each block says how many ids are before it."""
    docs = spark.range(0, 10_000, numPartitions=2).selectExpr("id AS doc_id", "repeat('a b ', CAST(id % 3 AS INT)) AS text")
    got = tf.token_files(docs, PATH, path=f"file://{tmp_path}/t", digest=False, as_read=True).orderBy("doc_id").collect()
    blocks = spark.read.parquet(f"{tmp_path}/t/blocks").orderBy("shard", "block").collect()
    assert [(b.shard, b.block) for b in blocks] == [(0, 0), (0, 1), (1, 0), (1, 1)] and [b.before for b in blocks[::2]] == [0, 0]
    assert [b.before for b in blocks[1::2]] == [sum(b.n_tokens) for b in blocks[::2]]
    at = 0
    for i, row in enumerate(got):
        assert (row.doc_id, row.start, row.n_tokens, len(row.ids)) == (i, at, 2 * (i % 3) + 1, row.n_tokens)
        at += row.n_tokens
