"""Language ID by a byte convolutional network."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Carried, small_batches, text_bytes

WINDOW = 256        # bytes that the network sees at once; a text is cut into such windows
WIDTHS = (2, 3, 4)  # bytes that a filter spans
FILTERS, DIM = 16, 8
SAMPLE_DOCS = 800   # documents of each language to learn from, about; PER_DOC windows of each at most
PER_DOC, EPOCHS, BATCH, STEP = 3, 5, 64, 0.004


def windows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts, the last of each padded with 0; and the text of each."""
    size = np.diff(off)
    n = -(-size // WINDOW)
    doc = np.repeat(np.arange(len(size)), n)
    at = off[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
    place = at[:, None] + np.arange(WINDOW)
    out = np.append(data, np.uint8(0))[np.minimum(place, len(data))]
    out[place >= off[doc + 1][:, None]] = 0
    return out, doc


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray           # 256 x DIM
    filters: list[np.ndarray]   # for each width: width x DIM x FILTERS
    bias: np.ndarray            # filters of all widths
    out: np.ndarray             # filters x languages
    out_bias: np.ndarray

    @classmethod
    def new(cls, languages: list[str], seed: int = 5) -> "Network":
        r = np.random.default_rng(seed)
        f = lambda *s, by: r.normal(0, by, s).astype(np.float32)
        n = FILTERS * len(WIDTHS)
        return cls(languages, f(256, DIM, by=0.5), [f(w, DIM, FILTERS, by=(1 / (w * DIM))**0.5) for w in WIDTHS],
                   np.zeros(n, np.float32), f(n, len(languages), by=0.1), np.zeros(len(languages), np.float32))

    def tables(self) -> None:
        """What each byte and each pair of bytes adds to the filters, so that a convolution is a few look-ups."""
        single = [[self.embed @ f[i] for i in range(len(f))] for f in self.filters]
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS).astype(np.float32)
        self.pairs = [[pair(s[i], s[i + 1]) for i in range(0, len(s) - 1, 2)] for s in single]
        self.rest = [s[-1].astype(np.float32) if len(s) % 2 else None for s in single]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the languages for windows."""
        if not hasattr(self, "pairs"):
            self.tables()
        found = []
        for i in range(0, len(x), 64):
            part = x[i:i + 64]
            two = part[:, :-1].astype(np.int32) * 256 + part[:, 1:]
            pooled = []
            for w, pairs, rest in zip(WIDTHS, self.pairs, self.rest, strict=True):
                n = WINDOW - w + 1
                total = pairs[0].take(two[:, :n], 0)
                for k, t in enumerate(pairs[1:], 1):
                    total += t.take(two[:, 2 * k:2 * k + n], 0)
                if rest is not None:
                    total += rest.take(part[:, w - 1:w - 1 + n], 0)
                pooled.append(total.max(1))
            found.append(softmax(np.maximum(np.concatenate(pooled, 1) + self.bias, 0) @ self.out + self.out_bias))
        return np.concatenate(found) if found else np.zeros((0, len(self.languages)), np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 6) -> "Network":
        """Adam on the cross-entropy; gradients go through the place of each maximum only."""
        r = np.random.default_rng(seed)
        params = [self.embed, *self.filters, self.bias, self.out, self.out_bias]
        first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(EPOCHS):
            order = r.permutation(len(x))
            for i in range(0, len(x), BATCH):
                b, want = x[order[i:i + BATCH]], y[order[i:i + BATCH]]
                e = self.embed[b]
                rows, best, pooled = np.arange(len(b)), [], []
                for w, f in zip(WIDTHS, self.filters, strict=True):
                    n = WINDOW - w + 1
                    conv = sum(e[:, k:k + n] @ f[k] for k in range(w))
                    best.append(conv.argmax(1))
                    pooled.append(conv.max(1))
                z = np.concatenate(pooled, 1) + self.bias
                a = np.maximum(z, 0)
                d = softmax(a @ self.out + self.out_bias)
                d[rows, want] -= 1
                d /= len(b)
                dz = (d @ self.out.T) * (z > 0)
                grads = [np.zeros_like(self.embed), *(np.zeros_like(f) for f in self.filters), dz.sum(0), a.T @ d, d.sum(0)]
                for j, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
                    g = dz[:, j * FILTERS:(j + 1) * FILTERS]
                    for k in range(w):
                        byte = b[rows[:, None], best[j] + k]
                        grads[1 + j][k] = np.einsum("bfd,bf->df", self.embed[byte], g)
                        np.add.at(grads[0], byte, g[:, :, None] * f[k].T[None])
                t += 1
                for p, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= STEP * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return self


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def train(labelled: DataFrame, per_language: int = SAMPLE_DOCS) -> Network:
    """From text and lang of rows, all languages: of each about per_language documents, chosen by the
    hash of their text, and PER_DOC windows of each. Only these windows reach the driver."""
    rows = labelled.select("text", "lang").dropna().filter(F.length("text") > 0)
    counts = rows.groupBy("lang").count().collect()
    languages = sorted(r["lang"] for r in counts)
    share = {r["lang"]: min(1.0, per_language / r["count"]) for r in counts}
    if not languages:
        return Network.new(["und"])
    limit = F.create_map(*[F.lit(v) for k in languages for v in (k, int(share[k] * 1_000_000))])
    chosen = (rows.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < F.try_element_at(limit, F.col("lang")))
              .groupBy(F.xxhash64("text").alias("h"), "lang").agg(F.first("text").alias("text")))

    def cut(batches):
        for batch in small_batches(batches, "text"):
            data, off = text_bytes(batch.column("text"))
            x, doc = windows(data, off)
            n = np.bincount(doc, minlength=batch.num_rows)
            rank = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            keep = rank * PER_DOC // n[doc] != (rank - 1) * PER_DOC // n[doc]
            yield pa.RecordBatch.from_arrays([batch.column("h").take(pa.array(doc[keep])), batch.column("lang").take(pa.array(doc[keep])),
                                              pa.array([w.tobytes() for w in x[keep]], pa.binary())], names=["h", "lang", "window"])

    got = (chosen.select("h", "lang", "text").mapInArrow(cut, "h bigint, lang string, window binary")
           .orderBy("h", "lang", "window").limit(2 * PER_DOC * per_language * len(languages)).toArrow())
    x = np.frombuffer(b"".join(got["window"].to_pylist()), np.uint8).reshape(-1, WINDOW)
    number = {k: i for i, k in enumerate(languages)}
    return Network.new(languages).fit(x, np.array([number[k] for k in got["lang"].to_pylist()], np.int64))


def identify(docs: DataFrame, model: Network) -> DataFrame:
    """docs with lang_pred and score, the mean probability over all windows of the whole text.

    Text that is null or has no letter is "und" with score 0. Of equal probabilities the first
    language in alphabetical order is taken. Each row is judged alone; columns of docs named
    lang_pred or score, in any case, are replaced; an empty table gives no rows, a model without
    languages "und".
    """
    own = Carried(docs, ["lang_pred", "score"])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = own.rows.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"))

    def judge(batches):
        net = shared.value
        for batch in small_batches(batches, "text", 1 << 20):
            data, off = text_bytes(batch.column("text"))
            total, n = np.zeros((batch.num_rows, len(net.languages))), np.zeros(batch.num_rows)
            step = 1 << 22  # bytes of one very long text
            for a in range(0, len(data), step) if batch.num_rows == 1 else [0]:
                part = (data[a:a + step], np.array([0, len(data[a:a + step])])) if batch.num_rows == 1 else (data, off)
                x, doc = windows(*part)
                np.add.at(total, doc, net.predict(x))
                n += np.bincount(doc, minlength=batch.num_rows)
            total /= np.maximum(n, 1)[:, None]
            best = total.argmax(1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(np.array(net.languages, object)[best], pa.string()),
                 pa.array(np.minimum(total[np.arange(len(best)), best], 1.0))], names=batch.schema.names)

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return own.restored(rows.mapInArrow(judge, rows.schema)
                        .withColumn("score", F.when(letters, F.col("score")).otherwise(0.0))
                        .withColumn("lang_pred", F.when(letters, F.col("lang_pred")).otherwise("und")))
