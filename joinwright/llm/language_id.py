"""Language identification with a byte convolutional network in numpy.

A text is cut into windows of 256 bytes, the last one padded with zeros.  Bytes
have small embeddings; filters of several widths slide over a window, each keeps
its largest response (max pooling), and a softmax layer over the pooled
responses gives the languages' scores.  The mean of the windows' scores, over
the whole text, decides.

The network is trained with Adam on a bounded sample: of each language at most
``PER_LANGUAGE`` texts, two windows each, from rows with a language outside the
held-out fold.

Edge cases: a null text, or one without a letter, is ``und`` with score 0;
without training rows every text is; ties go to the alphabetically first
language; repeated rows get equal results; rows with a null id are predicted;
empty tables give an empty table; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinwright.llm.folds import remainder
from joinwright.llm.textcore import byte_texts, passes

WINDOW = 256
EMBEDDING = 8
WIDTHS = (2, 3, 4)
FILTERS = 12
PER_LANGUAGE = 512
MODULUS, HELD = 4, 2
#: Windows convolved at once.
BATCH = 512

_WIDEST = max(WIDTHS)
_PLACES = WINDOW - _WIDEST + 1


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts as a (n, WINDOW) byte array, and the number of windows by text."""
    count = np.array([-(-len(t) // WINDOW) for t in texts], np.int64)
    padded = b"".join([t.ljust(-(-len(t) // WINDOW) * WINDOW, b"\0") for t in texts])
    return np.frombuffer(padded, np.uint8).reshape(-1, WINDOW), count


def _mask() -> np.ndarray:
    """Which inputs a filter of each width sees, for filters side by side."""
    mask = np.zeros((_WIDEST, EMBEDDING, len(WIDTHS) * FILTERS), np.float32)
    for i, w in enumerate(WIDTHS):
        mask[:w, :, i * FILTERS : (i + 1) * FILTERS] = 1
    return mask.reshape(_WIDEST * EMBEDDING, -1)


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def patches(self, batch: np.ndarray) -> np.ndarray:
        """Embeddings under every place of the filters: (n * places, widest * embedding)."""
        flat = self.embedding[batch].reshape(len(batch), WINDOW * EMBEDDING)
        strides = (flat.strides[0], EMBEDDING * flat.itemsize, flat.itemsize)
        view = np.lib.stride_tricks.as_strided(flat, (len(batch), _PLACES, _WIDEST * EMBEDDING), strides)
        return view.reshape(-1, _WIDEST * EMBEDDING)

    def scores(self, batch: np.ndarray) -> np.ndarray:
        """Log probabilities of the languages for each window."""
        parts = []
        for a in range(0, len(batch), BATCH):
            some = batch[a : a + BATCH]
            response = (self.patches(some) @ self.filters).reshape(len(some), _PLACES, -1)
            parts.append(np.maximum(response.max(axis=1) + self.bias, 0))
        z = np.concatenate(parts) @ self.out + self.out_bias
        return z - np.logaddexp.reduce(z, axis=1, keepdims=True)

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the likeliest language and its probability for each non-empty text."""
        cut, count = windows(texts)
        mean = np.add.reduceat(self.scores(cut), np.cumsum(count) - count, axis=0) / count[:, None]
        p = np.exp(mean - np.logaddexp.reduce(mean, axis=1, keepdims=True))
        return p.argmax(axis=1), p.max(axis=1)


def fit(batch: np.ndarray, labels: np.ndarray, languages: list[str], rounds: int = 400, size: int = 64, seed: int = 11) -> Network:
    """Adam on the cross entropy; classes are drawn evenly."""
    draw = np.random.default_rng(seed)
    n_filters, mask = len(WIDTHS) * FILTERS, _mask()
    fan = np.repeat([w * EMBEDDING for w in WIDTHS], FILTERS)
    f32 = np.float32
    net = Network(
        languages,
        draw.normal(0, 0.5, (256, EMBEDDING)).astype(f32),
        (draw.normal(0, 1, mask.shape) / np.sqrt(fan) * mask).astype(f32),
        np.zeros(n_filters, f32),
        draw.normal(0, 1 / np.sqrt(n_filters), (n_filters, len(languages))).astype(f32),
        np.zeros(len(languages), f32),
    )
    names = ("embedding", "filters", "bias", "out", "out_bias")
    first = {k: np.zeros_like(getattr(net, k)) for k in names}
    second = {k: np.zeros_like(getattr(net, k)) for k in names}
    members = [np.flatnonzero(labels == i) for i in range(len(languages))]
    for step in range(1, rounds + 1):
        y = draw.integers(0, len(languages), size)
        at = np.array([draw.choice(members[i]) for i in y])
        some = batch[at]
        patch = net.patches(some)
        response = (patch @ net.filters).reshape(size, _PLACES, n_filters)
        where = response.argmax(axis=1)
        pooled = np.take_along_axis(response, where[:, None], axis=1)[:, 0] + net.bias
        active = np.maximum(pooled, 0)
        z = active @ net.out + net.out_bias
        p = np.exp(z - np.logaddexp.reduce(z, axis=1, keepdims=True))
        p[np.arange(size), y] -= 1
        p /= size
        back = (p @ net.out.T) * (pooled > 0)
        rows = patch.reshape(size, _PLACES, -1)[np.arange(size)[:, None], where]
        grad_filters = np.einsum("bfk,bf->kf", rows, back) * mask
        grad_rows = back[:, :, None] * net.filters.T
        grad_embedding = np.zeros_like(net.embedding)
        for k in range(_WIDEST):
            np.add.at(grad_embedding, some[np.arange(size)[:, None], where + k], grad_rows[:, :, k * EMBEDDING : (k + 1) * EMBEDDING])
        gradient = {"embedding": grad_embedding, "filters": grad_filters, "bias": back.sum(axis=0), "out": active.T @ p + 1e-4 * net.out, "out_bias": p.sum(axis=0)}
        for k in names:
            first[k] = 0.9 * first[k] + 0.1 * gradient[k]
            second[k] = 0.99 * second[k] + 0.01 * gradient[k] ** 2
            move = 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
            setattr(net, k, (getattr(net, k) - move).astype(f32))
    return net


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Network | None:
    """Trains on at most ``per_language`` texts of each language; None without a usable row.

    One text for each language and hash bucket of the id is kept, so the sample
    is drawn with map-side aggregation and no language is gathered in one task.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0) & F.col("doc_id").isNotNull()).where(remainder("doc_id", MODULUS) != HELD)
    key = F.xxhash64("doc_id")
    size = F.octet_length("text")
    # the first window and one from the middle, cut on the executors
    raw = F.encode("text", "UTF-8")
    middle = (F.floor(size / (2 * WINDOW)) * WINDOW + 1).cast("int")
    pick = F.struct(raw.substr(F.lit(1), F.lit(WINDOW)).alias("a"), raw.substr(middle, F.lit(WINDOW)).alias("b"))
    rows = usable.select("lang", F.pmod(key, F.lit(per_language)).alias("bucket"), key.alias("key"), pick.alias("cut"))
    found = rows.groupBy("lang", "bucket").agg(F.min(F.struct("key", "cut")).alias("m")).select("lang", "bucket", "m.cut.a", "m.cut.b")
    sample = sorted(found.collect(), key=lambda r: (r["lang"], r["bucket"]))  # languages x per_language rows of two windows
    if not sample:
        return None
    languages = sorted({r["lang"] for r in sample})
    cuts, labels = [], []
    for r in sample:
        for part in (r["a"], r["b"]):
            if part:
                cuts.append(bytes(part)[:WINDOW].ljust(WINDOW, b"\0"))
                labels.append(languages.index(r["lang"]))
    return fit(np.frombuffer(b"".join(cuts), np.uint8).reshape(-1, WINDOW), np.array(labels), languages)


def identify(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(network)  # fixed size but for the number of languages

    def run(batches):
        net = shared.value
        for batch in batches:
            rows = byte_texts(batch.column(1))
            known = batch.column(2).to_pylist()
            for a, b in passes(rows):
                best, score = ["und"] * (b - a), [0.0] * (b - a)
                use = [i for i in range(a, b) if known[i]] if net is not None else []
                if use:
                    found, p = net.predict([rows[i] for i in use])
                    for i, language, x in zip(use, found, p, strict=True):
                        best[i - a], score[i - a] = net.languages[language], float(x)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(best), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    text = F.col(text_col).cast("string")
    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"), letters.alias("letters")).mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = (remainder("doc_id", MODULUS) == HELD).alias("held_out")
    return identify(docs, train(docs)).select("doc_id", held, "lang_pred", "score")
