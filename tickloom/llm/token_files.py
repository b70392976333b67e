"""Token ids in files: one zstandard dictionary for all, a frame for each document, an index of offsets."""

from __future__ import annotations

import hashlib
import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions, shared_dir, small_batches

END_ID = 1
SAMPLE_DOCS, SAMPLE_IDS = 400, 4096   # the dictionary is trained on at most so many documents, and ids of each
DICTIONARY_BYTES = 64 << 10
BLOCK_BYTES, BLOCK_DOCS = 1 << 20, 4096
CACHE_WORDS, CACHE_BYTES = 1_000_000, 32 << 20  # words that a process remembers, at most about
PIECE = 1 << 20

BLOCKS = T.StructType([
    T.StructField("shard", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("before", T.LongType()),
    T.StructField("dictionary", T.StringType()), T.StructField("width", T.IntegerType()),
    T.StructField("doc_id", T.ArrayType(T.LongType())), T.StructField("offset", T.ArrayType(T.LongType())),
    T.StructField("n_tokens", T.ArrayType(T.LongType())), T.StructField("data", T.BinaryType())])


#: The normalizer and pre-tokenizer of tokenizers whose words can be encoded one by one.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}


def cuts_at_blanks(path: str) -> bool:
    """Whether the tokenizer drops white space, lowers letters, and marks ends of words."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    return (spec.get("normalizer") == NORMALIZER and [x for x in pre.get("pretokenizers", ()) if x["type"] != "ByteLevel"] == [SPLIT]
            and len(pre["pretokenizers"]) == 2 and model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>"
            and not model.get("dropout") and not any(t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]))


class Encoder:
    """Ids of texts. Where the tokenizer cuts at white space and drops it, what stands between
    is encoded by itself and remembered; words of letters are learned in lower case, as the
    tokenizer lowers them anyway. Other tokenizers get each text whole. With literal_markers the
    names of special tokens in a text are plain text; else they are those tokens, as the tokenizer has it."""

    def __init__(self, path: str, literal_markers: bool = False):
        from tokenizers import Tokenizer
        from tokenizers import normalizers as N
        from tokenizers import pre_tokenizers as P

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal_markers
        size = self.tokenizer.get_vocab_size()
        self.width = 2 if size <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.by_word = cuts_at_blanks(path)
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.lower = Tokenizer.from_file(path)  # the same model for words of lower-case letters, which need no rules
        self.lower.normalizer = N.Sequence([])
        self.lower.pre_tokenizer = P.Sequence([P.Split(" ", "removed"), P.ByteLevel(add_prefix_space=False, use_regex=False)])
        found = [np.frombuffer(x, self.dtype) for x in self.one(list(MARKS))]
        self.marks = np.array([x[0] if len(x) == 1 else 0 for x in found], self.dtype)
        self.by_word &= all(len(x) == 1 for x in found)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.bytes = 0
        self.pool, self.used = np.zeros(1 << 16, self.dtype), 0   # ids of all known words
        self.place, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Little-endian ids of each text; null is empty."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            return self.one(texts.to_pylist())
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        out, i = [], 0
        for k in [*np.flatnonzero(sizes > PIECE).tolist(), len(texts)]:
            out += self.of_words(texts.slice(i, k - i))
            if k < len(texts):
                out.append(b"".join(b"".join(self.of_words(pa.array([p]))) for p in pieces(texts[k].as_py())))
            i = k + 1
        return out

    def of_words(self, texts: pa.Array) -> list[bytes]:
        """All words of the texts as numbers and marks, then the ids of all in one gathering."""
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        if not len(coded):
            return [b""] * len(texts)
        number, mark = self.numbers(coded.dictionary)
        word = coded.indices.to_numpy()
        number, mark = number[word], mark[word]
        n = self.length[number]
        stop = np.cumsum(n + (mark >= 0))
        at = np.arange(stop[-1]) + np.repeat(self.place[number] - (stop - n - (mark >= 0)), n + (mark >= 0))
        ids = self.pool[at]
        marked = np.flatnonzero(mark >= 0)
        ids[stop[marked] - 1] = self.marks[mark[marked]]
        ids = ids.tobytes()
        off = np.concatenate([[0], stop])[split.offsets.to_numpy() - split.offsets[0].as_py()] * self.width
        return [ids[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]

    def numbers(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """What each word is known as, and the mark behind it, or -1: a word of letters with a mark is two."""
        plain = pc.match_substring_regex(words, LETTERS)
        core = pc.utf8_rtrim(words, "".join(MARKS))
        marked = pc.and_(plain, pc.not_equal(core, words)).to_numpy(zero_copy_only=False)
        mark = np.full(len(words), -1)
        mark[marked] = pc.index_in(pc.utf8_slice_codeunits(words.filter(pa.array(marked)), -1), value_set=pa.array(MARKS)).to_numpy()
        core = pc.if_else(plain, pc.utf8_lower(core), words)
        kinds = core.dictionary_encode()
        names = kinds.dictionary.to_numpy(zero_copy_only=False)
        found = np.fromiter((-1 if k is None else k for k in map(self.known.get, names)), np.int64, len(names))
        if found.min() < 0:
            if self.known and (len(self.known) + (found < 0).sum() > CACHE_WORDS or self.bytes > CACHE_BYTES):
                self.forget()
                found[:] = -1
            letters = np.zeros(len(names), bool)
            letters[kinds.indices.to_numpy()] = plain.to_numpy(zero_copy_only=False)
            for some in (letters, ~letters):
                self.learn(names[(found < 0) & some].tolist(), some is letters)
            new = np.flatnonzero(found < 0)
            found[new] = [self.known[x] for x in names[new]]
        return found[kinds.indices.to_numpy()], mark

    def learn(self, words: list[str], plain: bool) -> None:
        """Plain words are in lower case and learned many in one call; each ends with the one id that ends a word."""
        ids, sizes = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        for i in range(0, len(words), 2048):
            part = words[i:i + 2048]
            own = np.array(self.lower.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids if plain else [], self.dtype)
            stop = np.flatnonzero(self.ends[own]) + 1
            if not plain or len(stop) != len(part) or stop[-1] != len(own):
                each = self.one(part)
                own, stop = np.frombuffer(b"".join(each), self.dtype), np.cumsum([len(x) // self.width for x in each])
            ids.append(own)
            sizes.append(np.diff(stop, prepend=0))
        ids, sizes = np.concatenate(ids), np.concatenate(sizes)
        k, more = len(self.known), len(words)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while k + more > len(self.place):
            self.place, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.place, self.length))
        self.pool[self.used:self.used + len(ids)] = ids
        self.length[k:k + more] = sizes
        self.place[k:k + more] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.known.update(zip(words, range(k, k + more), strict=True))
        self.bytes += sum(map(len, words))

    def one(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)] if words else []


MARKS = (".", ",", ";", ":", "!", "?")
LETTERS = "^[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+[.,;:!?]?$"  # lowering these is the same everywhere


def pieces(text: str):
    """The text with blanks only, cut at some of them if it is very long; a piece over PIECE has none."""
    text = text.translate(BLANK)
    at = 0
    while len(text) - at > PIECE:
        cut = text.rfind(" ", at, at + PIECE + 1)
        if cut < 0:
            cut = text.find(" ", at + PIECE)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


BLANK = str.maketrans("\t\n\r\f\v", "     ")

_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, literal_markers: bool = False) -> Encoder:
    """One for each worker process, as workers serve many tasks."""
    key = path, literal_markers
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def train_dictionary(docs: DataFrame, tokenizer: str, literal_markers: bool = False) -> bytes:
    """From the documents with the smallest hashes of their ids."""
    sample = docs.select("doc_id", "text").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)

    def ids(batches):
        for batch in batches:
            coder = encoder(tokenizer, literal_markers)
            out = [x[:SAMPLE_IDS * coder.width] for x in coder.encode(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])

    rows = [bytes(r[0]) for r in sample.mapInArrow(ids, "ids binary").collect() if r[0]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, rows, k=256, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too short documents
        return b"".join(rows)[:DICTIONARY_BYTES] or bytes(8)


def dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(data)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, order: Column | None = None,
                 literal_markers: bool = False, as_read: bool = False) -> None:
    """Write docs, in ascending doc_id or the given order, as token files below path; as_read in the order in which
    they come, without a shuffle.

    path/dictionary has one row: the dictionary and its sha256. path/blocks has rows of at
    most BLOCK_DOCS documents or about BLOCK_BYTES: how many ids of its shard are before it, dictionary hash, bytes per id, ids of the
    documents, offset and number of tokens of each, and the frames one after another. So a
    reader finds a document from the small columns and decompresses nothing else. Shards are
    Spark partitions by range of the order, or those of docs as_read; a lost task writes the same again.

    Null text is empty and has the end id alone. A null doc_id comes first; rows with the
    same doc_id follow one another in the order of a hash of their texts. Further columns are not written; an
    empty table gives an empty set of blocks. The end id must fit the ids' width. A special
    token's name in a text is that token, unless literal_markers is set.
    """
    spark = docs.sparkSession
    trained = train_dictionary(docs, tokenizer, literal_markers)
    name = hashlib.sha256(trained).hexdigest()
    spark.createDataFrame([(name, bytearray(trained))], "dictionary string, data binary").coalesce(1).write.parquet(f"{path}/dictionary")
    shared = spark.sparkContext.broadcast(trained)

    def encode(batches):
        coder, common = encoder(tokenizer, literal_markers), dictionary(shared.value)
        common.precompute_compress(level=3)
        press = zstandard.ZstdCompressor(level=3, dict_data=common)
        end = np.array([end_id], coder.dtype).tobytes()
        shard, block = TaskContext.get().partitionId(), 0
        ids, offsets, sizes, frames, size, before = [], [], [], [], 0, 0

        def flush():
            row = {"shard": [shard], "block": [block], "before": [before], "dictionary": [name], "width": [coder.width], "doc_id": [ids],
                   "offset": [offsets], "n_tokens": [sizes], "data": [b"".join(frames)]}
            return pa.RecordBatch.from_pydict(row, schema=ARROW)

        for batch in small_batches(batches, "text", 8 << 20):
            for doc, raw in zip(batch.column("doc_id").to_pylist(), coder.encode(batch.column("text")), strict=True):
                frame = press.compress(raw + end)
                ids.append(doc)
                offsets.append(size)
                sizes.append(len(raw) // coder.width + 1)
                frames.append(frame)
                size += len(frame)
                if size >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS:
                    yield flush()
                    block, before = block + 1, before + sum(sizes)
                    ids, offsets, sizes, frames, size = [], [], [], [], 0
        if ids:
            yield flush()

    key = F.col("doc_id") if order is None else order
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([] if as_read else [key.alias("key")]))
    if not as_read:
        tie = F.xxhash64("text")  # parts a key that many rows have
        rows = rows.repartitionByRange(partitions(docs), "key", tie).sortWithinPartitions("key", tie, "text").drop("key")
    (rows.mapInArrow(encode, BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks"))


ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("dictionary", pa.string()), ("width", pa.int32()),
                   ("doc_id", pa.list_(pa.int64())), ("offset", pa.list_(pa.int64())),
                   ("n_tokens", pa.list_(pa.int64())), ("data", pa.binary())])


def read_tokens(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids (array<int>; with digest ids_crc32 instead) from files.

    start counts the ids of all documents before it. Blocks are decompressed where they are
    read; only the number of ids of each shard, one row for each task that wrote, is put in order and broadcast.
    """
    stored = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(bytes(stored["data"])).hexdigest() != stored["dictionary"]:
        raise ValueError("the dictionary does not have the hash that it is stored under")
    shared = spark.sparkContext.broadcast((stored["dictionary"], bytes(stored["data"])))
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    counts = blocks.groupBy("shard").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long")).alias("base"))

    def decode(batches):
        name, trained = shared.value
        press = zstandard.ZstdDecompressor(dict_data=dictionary(trained))
        for batch in batches:
            for row in range(batch.num_rows):
                r = {k: batch.column(k)[row].as_py() for k in ("dictionary", "width", "doc_id", "offset", "n_tokens", "start", "data")}
                if r["dictionary"] != name:
                    raise ValueError("a block was written with another dictionary")
                dtype, begin, out = f"<u{r['width']}", r["start"], []
                for at, stop, n in zip(r["offset"], [*r["offset"][1:], len(r["data"])], r["n_tokens"], strict=True):
                    found = np.frombuffer(press.decompress(r["data"][at:stop]), dtype)
                    if len(found) != n:
                        raise ValueError("a document has another length than its index says")
                    out.append(zlib.crc32(found.astype("<u4").tobytes()) if digest else found.astype(np.int32))
                total = np.cumsum([0, *r["n_tokens"]])[:-1] + begin
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_id"], pa.int64()), pa.array(total, pa.int64()), pa.array(r["n_tokens"], pa.int64()),
                     pa.array(out, pa.int64() if digest else pa.list_(pa.int32()))],
                    names=["doc_id", "start", "n_tokens", "last"])

    last = "ids_crc32" if digest else "ids"
    kind = "bigint" if digest else "array<int>"
    placed = blocks.join(F.broadcast(bases), "shard").withColumn("start", F.col("base") + F.col("before"))
    out = placed.mapInArrow(decode, f"doc_id bigint, start bigint, n_tokens bigint, last {kind}")
    return out.withColumnRenamed("last", last)


def token_files(docs: DataFrame, tokenizer: str, path: str | None = None, digest: bool = True, order: Column | None = None,
                literal_markers: bool = False, as_read: bool = False) -> DataFrame:
    """Write docs' token files (below the shared folder if no path is given) and read them back."""
    path = path or shared_dir(docs.sparkSession)
    write_tokens(docs, path, tokenizer, order=order, literal_markers=literal_markers, as_read=as_read)
    return read_tokens(docs.sparkSession, path, digest)
