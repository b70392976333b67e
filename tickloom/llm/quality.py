"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Carried, U, hashes_of, mix, small_batches, text_bytes, words_of

SAMPLE = 20_000     # labelled rows to learn from, at most: those whose doc_id hashes lowest
TREES, LEVELS, BINS, RATE, RIDGE = 60, 4, 64, 0.2, 1.0
THRESHOLD = 0.3


def byte_class(text: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(text)] = True
    return out


CLASSES = {
    "upper": byte_class(bytes(range(65, 91))), "lower": byte_class(bytes(range(97, 123))), "digit": byte_class(b"0123456789"),
    "blank": byte_class(b" \t"), "newline": byte_class(b"\n"), "stop": byte_class(b".?"), "shout": byte_class(b"!"),
    "comma": byte_class(b",;:"), "symbol": byte_class(b"#$%&*@^~+=<>/\\_"), "bar": byte_class(b"|"),
    "bracket": byte_class(b"()[]{}\"'"), "wide": byte_class(bytes(range(128, 256)))}
NOT_SPACE = ~byte_class(b" \t\n\r\f\v")
NOT_NEWLINE = ~CLASSES["newline"]
FEATURES = ["bytes", *CLASSES, "shouted", "words", "word_length", "distinct_words", "top_word", "lines", "distinct_lines", "words_a_line"]


def per_doc(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return (total[off[1:]] - total[off[:-1]]).astype(float)


def distinct(h: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of different hashes in each document, and how often its most frequent one occurs."""
    _, at, n = np.unique(mix(h + doc.astype(np.uint64) * U(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
    most = np.zeros(docs)
    np.maximum.at(most, doc[at], n)
    return np.bincount(doc[at], minlength=docs).astype(float), most


def statistics(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text; shares are of bytes, words or lines."""
    data, off = text_bytes(column)
    docs, size = len(column), np.maximum(np.diff(off), 1)
    counts = {k: per_doc(c[data], off) for k, c in CLASSES.items()}
    ws, we, wd = words_of(data, off, NOT_SPACE)
    ls, le, ld = words_of(data, off, NOT_NEWLINE)
    words, lines = np.bincount(wd, minlength=docs).astype(float), np.bincount(ld, minlength=docs).astype(float)
    word_kinds, top = distinct(hashes_of(data, ws, we), wd, docs)
    line_kinds, _ = distinct(hashes_of(data, ls, le), ld, docs)
    some = np.maximum(words, 1)
    return np.column_stack([
        np.log1p(np.diff(off)), *(counts[k] / size for k in CLASSES),
        counts["upper"] / np.maximum(counts["upper"] + counts["lower"], 1), np.log1p(words),
        np.bincount(wd, we - ws, docs) / some, word_kinds / some, top / some, np.log1p(lines),
        line_kinds / np.maximum(lines, 1), words / np.maximum(lines, 1)])


@dataclass
class Trees:
    """Complete trees as arrays: node i of a level sends rows over its threshold to 2 i + 2."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(LEVELS):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += leaf[node - len(f)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Newton boosting of the logistic loss. Without rows, every score is 0.5."""
    inner, leaves = 2**LEVELS - 1, 2**LEVELS
    p = (y.sum() + 1) / (len(y) + 2)
    out = Trees(float(np.log(p / (1 - p))), np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, leaves)))
    if not len(y) or y.min() == y.max():
        return out
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])) for c in x.T]
    bins = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
    margin = np.full(len(y), out.base)
    for tree in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h, node = p - y, p * (1 - p), np.zeros(len(y), np.int64)
        for level in range(LEVELS):
            n = 2**level
            best, where = np.full(n, 1e-6), np.full((n, 2), -1)
            for f in range(x.shape[1]):
                slot = node * BINS + bins[:, f]
                gs = np.bincount(slot, g, n * BINS).reshape(n, BINS).cumsum(1)
                hs = np.bincount(slot, h, n * BINS).reshape(n, BINS).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + RIDGE) + (gt - gs)**2 / (ht - hs + RIDGE) - gt**2 / (ht + RIDGE)
                gain[(hs < 1) | (ht - hs < 1)] = 0
                at = gain[:, :len(edges[f])].argmax(1) if len(edges[f]) else np.zeros(n, np.int64)
                top = gain[np.arange(n), at] if len(edges[f]) else np.zeros(n)
                better = top > best
                best[better], where[better] = top[better], np.column_stack([np.full(n, f), at])[better]
            for i, (f, b) in enumerate(where):
                if f >= 0:
                    out.feature[tree, n - 1 + i], out.threshold[tree, n - 1 + i] = f, edges[f][b]
            f = out.feature[tree, n - 1 + node]
            node = 2 * node + (x[np.arange(len(y)), f] > out.threshold[tree, n - 1 + node])
        gs, hs = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
        out.leaf[tree] = -RATE * gs / (hs + RIDGE)
        margin += out.leaf[tree][node]
    return out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """From at most ``sample`` labelled documents, whose ids are broadcast; only statistics reach the driver. Of labels that
    contradict one another the more frequent one counts, of a tie 1; of texts with the same doc_id the one of the least statistics."""
    chosen = (labels.select(F.col("doc_id"), F.col("quality").cast("double").alias("y")).dropna().groupBy("doc_id").agg(F.round(F.avg("y")).alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def count(batches):
        for batch in small_batches(batches, "text"):
            x = statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("y"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))],
                names=["doc_id", "y", "x"])

    kind = dict(docs.dtypes)["doc_id"]
    got = rows.mapInArrow(count, f"doc_id {kind}, y double, x array<double>").groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("r")).orderBy("doc_id").select("r.*").toArrow()
    x = np.array(got["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x, got["y"].to_numpy())


def quality_scores(docs: DataFrame, model: Trees) -> DataFrame:
    """docs with score (0 to 1: how likely the quality label is 1) and predicted (score >= 0.3).

    Null text counts as empty; empty texts have the score that their statistics give. Each
    row is scored alone, so repeated rows and ties score alike. Columns of docs named score
    or predicted, in any case, are replaced; an empty table gives no rows.
    """
    own = Carried(docs, ["score", "predicted"])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = own.rows.withColumn("score", F.lit(0.0))

    def score(batches):
        for batch in small_batches(batches, "text"):
            s = pa.array(shared.value.score(statistics(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], s], names=batch.schema.names)

    return own.restored(rows.mapInArrow(score, rows.schema).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))
