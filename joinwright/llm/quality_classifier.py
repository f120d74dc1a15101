"""Quality classifier: random-indexing word vectors, a two-layer network, calibrated probabilities.

Every word of the *whole* corpus has a vector: the sum of its neighbours' sparse
random index vectors over all its occurrences, damped and normalised.  Vectors
lie in a table of fixed size, each word in two entries chosen by two hashes of the whole word, whose
sum is its vector; two words that share one entry hardly ever share the other.  A
word of more than ``LONG`` bytes, as in a text without spaces, is read as pieces of
``PIECE`` bytes cut between characters.  A document is the mean of its words'
vectors, its length, for neighbouring words and words two apart the mean similarity of
their vectors and the part that is the same word, the mean log frequency of its words and their mean length, and the log of
the word count; a two-layer numpy network trained on a bounded sample of labelled rows
scores it, and a temperature fitted on a part of the sample that the network has not
seen calibrates the probabilities.

The sums are taken per partition in a table whose size is fixed (VOCABULARY x
DIMENSIONS), then added block by block in three levels of at most ``FAN`` tables
each, so that no task reads more than FAN blocks, or one for each FAN ** 2 partitions.

Edge cases: null and empty texts have the zero vector and a score like any text;
without usable labels every score is 0.5; repeated rows get equal scores; rows
with a null id are scored; empty tables give an empty table; other columns are
not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinwright.llm.folds import labelled_sample, remainder, sampled_texts
from joinwright.llm.textcore import Words, byte_texts, mix, passes

VOCABULARY = 1 << 15
LONG, PIECE = 24, 8
DIMENSIONS = 32
NONZERO = 2
REACH = 2
BLOCKS = 64
FAN = 64
SAMPLE = 8000
MODULUS, HELD = 5, 0
THRESHOLD = 0.3
HIDDEN = 32

_U = np.uint64


class Tokens:
    """Words of a list of texts, long ones in pieces: their fingerprints, lengths in bytes and places."""

    def __init__(self, texts: list[bytes]):
        words = Words(texts)
        long = words.ends - words.starts
        pieces = np.where(long > LONG, -(-long // PIECE), 1)
        starts = np.repeat(words.starts, pieces)
        starts = starts + PIECE * (np.arange(len(starts)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        last = np.cumsum(pieces) - 1
        for _ in range(3):  # a character has three more bytes at most
            inside = (words.buf[starts] & 0xC0) == 0x80
            inside[last[pieces == 1]] = False
            starts = starts + inside
        ends = np.append(starts[1:], 0)
        ends[last] = words.ends
        starts = np.minimum(starts, ends)
        self.hashes = words.span_hashes(starts, ends)
        self.sizes = ends - starts
        text = np.repeat(words.text_of_word(), pieces)
        self.first = np.searchsorted(text, np.arange(len(texts) + 1))
        self.counts, self.text = np.diff(self.first), text

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Both vocabulary entries of each word."""
        return tuple((mix(self.hashes + _U(k)) % _U(VOCABULARY)).astype(np.int64) for k in (1, 2))

    def index_vectors(self) -> tuple[np.ndarray, np.ndarray]:
        """Dimensions and signs of each word's random index vector, a column for each nonzero."""
        keys = [mix(self.hashes + _U(0x5EED + z)) for z in range(NONZERO)]
        return np.stack([k % _U(DIMENSIONS) for k in keys], axis=1).astype(np.int64), np.stack([np.where((k >> _U(40)) & _U(1), 1.0, -1.0) for k in keys], axis=1)


def contexts(tokens: Tokens) -> np.ndarray:
    """Sum of the index vectors around each entry's occurrences, with occurrences in the last column."""
    dims, signs = tokens.index_vectors()
    places, weights = [], []
    for gap in range(1, REACH + 1):
        inside = np.flatnonzero(tokens.text[:-gap] == tokens.text[gap:])
        for own, other in ((inside, inside + gap), (inside + gap, inside)):
            for z in range(NONZERO):
                places.append((own, dims[other, z]))
                weights.append(signs[other, z])
    own, dim = (np.concatenate([p[i] for p in places]) for i in (0, 1))
    weight = np.concatenate(weights)
    table = np.zeros((VOCABULARY, DIMENSIONS + 1))
    for entry in tokens.entries():
        table[:, :-1] += np.bincount(entry[own] * DIMENSIONS + dim, weights=weight, minlength=VOCABULARY * DIMENSIONS).reshape(VOCABULARY, DIMENSIONS)
        table[:, -1] += np.bincount(entry, minlength=VOCABULARY)
    return table


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Vectors of the vocabulary's entries from every text of ``docs``, with the log frequency in the last column."""
    rows = VOCABULARY // BLOCKS

    def add_up(batches):
        table = np.zeros((VOCABULARY, DIMENSIONS + 1))
        for batch in batches:
            texts = byte_texts(batch.column(0))
            for a, b in passes(texts):
                table += contexts(Tokens([t or b"" for t in texts[a:b]]))
        cuts = [table[i * rows : (i + 1) * rows].astype(np.float32).tobytes() for i in range(BLOCKS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array(cuts, pa.binary())], names=["block", "sums"])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(rows * (DIMENSIONS + 1))
        for s in group["sums"]:
            total += np.frombuffer(s, np.float32)
        return pd.DataFrame({"block": [group["block"].iat[0]], "part": [group["part"].iat[0]], "sums": [total.astype(np.float32).tobytes()]})

    level = docs.select(F.col(text_col).cast("string")).mapInArrow(add_up, "block int, sums binary").withColumn("part", F.spark_partition_id())
    for fan in (FAN, FAN, None):
        level = level.select("block", "sums", (F.expr(f"part div {fan}") if fan else F.lit(0)).cast("int").alias("part")).groupBy("block", "part").applyInPandas(merge, "block int, part int, sums binary")
    table = np.zeros((BLOCKS, rows, DIMENSIONS + 1), np.float32)
    for block, sums in level.select("block", "sums").collect():  # BLOCKS rows of fixed size
        table[block] = np.frombuffer(bytes(sums), np.float32).reshape(rows, -1)
    return finished(table.reshape(VOCABULARY, -1))


def finished(table: np.ndarray) -> np.ndarray:
    """Damped, normalised vectors and log frequencies of a table of sums and counts."""
    vectors = table[:, :-1] / np.sqrt(table[:, -1:] + 1)
    vectors = np.sign(vectors) * np.log1p(np.abs(vectors))
    vectors = vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-6)
    total = max(float(table[:, -1].sum()), 1.0)
    return np.hstack([vectors, np.log1p(table[:, -1:] * (1e6 / total)) / 10]).astype(np.float32)


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """A row for each text, as the module's docstring has it."""
    tokens = Tokens(texts)
    out = np.zeros((len(texts), DIMENSIONS + 8), np.float32)
    filled = np.flatnonzero(tokens.counts)
    if len(filled):
        at, n = tokens.first[:-1][filled], tokens.counts[filled]
        one, two = tokens.entries()
        found = (vectors[one] + vectors[two]) / 2
        mean = np.add.reduceat(found, at, axis=0) / n[:, None]
        out[filled, : DIMENSIONS + 1] = mean
        out[filled, DIMENSIONS + 1] = np.linalg.norm(mean[:, :-1], axis=1)
        for gap in (1, 2):
            near = np.zeros(len(found), np.float32)
            inside = np.flatnonzero(tokens.text[:-gap] == tokens.text[gap:])
            near[inside] = np.einsum("ij,ij->i", found[inside, :-1], found[inside + gap, :-1])
            out[filled, DIMENSIONS + 1 + gap] = np.add.reduceat(near, at) / n
            near[inside] = tokens.hashes[inside] == tokens.hashes[inside + gap]
            out[filled, DIMENSIONS + 3 + gap] = np.add.reduceat(near, at) / n
        out[filled, DIMENSIONS + 6] = np.add.reduceat(tokens.sizes, at) / n / 10
    out[:, -1] = np.log1p(tokens.counts) / 10
    return out


@dataclass
class Network:
    """tanh hidden layer, logistic output divided by a temperature."""

    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.shift) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 400, seed: int = 7) -> Network:
    """Adam on the log loss over 80 % of the rows, temperature on the others."""
    draw = np.random.default_rng(seed)
    order = draw.permutation(len(x))
    held, used = order[: max(1, len(x) // 5)], order[max(1, len(x) // 5) :]
    if not len(used):
        used = held
    shift, scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-3
    net = Network(shift, scale, draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), 0.0)
    names = ("w1", "b1", "w2", "b2")
    first, second = {k: 0.0 for k in names}, {k: 0.0 for k in names}
    for step in range(1, rounds + 1):
        batch = used[draw.integers(0, len(used), 256)]
        z, t = (x[batch] - shift) / scale, y[batch]
        hidden = np.tanh(z @ net.w1 + net.b1)
        error = (1 / (1 + np.exp(-np.clip(hidden @ net.w2 + net.b2, -40, 40))) - t) / len(batch)
        back = np.outer(error, net.w2) * (1 - hidden**2)
        gradient = {"w1": z.T @ back + 1e-4 * net.w1, "b1": back.sum(axis=0), "w2": hidden.T @ error + 1e-4 * net.w2, "b2": error.sum()}
        for k in names:
            first[k] = 0.9 * first[k] + 0.1 * gradient[k]
            second[k] = 0.999 * second[k] + 0.001 * gradient[k] ** 2
            move = 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            setattr(net, k, getattr(net, k) - move)
    z, t = net.logits(x[held]), y[held]
    losses = [(np.mean(np.logaddexp(0, z / c) - t * z / c), c) for c in np.geomspace(0.25, 8, 60)]
    net.temperature = float(min(losses)[1])
    return net


@dataclass
class Model:
    vectors: np.ndarray
    network: Network | None

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), 0.5)
        return self.network.score(pooled(texts, self.vectors))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Word vectors from all of ``docs``; network from at most ``sample`` labelled rows outside the held-out fold."""
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # fixed size

    def run(batches):
        for batch in batches:
            rows = byte_texts(batch.column(1))
            for a, b in passes(rows):
                x = pooled([t or b"" for t in rows[a:b]], shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(x.tolist(), pa.list_(pa.float32()))], names=["doc_id", "y", "x"])

    found = sampled_texts(docs, labelled_sample(labels, "quality", MODULUS, HELD, sample)).mapInArrow(run, "doc_id bigint, y int, x array<float>").toArrow().sort_by("doc_id")
    y = found.column("y").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return Model(vectors, None)
    x = found.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), -1).astype(float)
    return Model(vectors, fit(x, y))


def quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size

    def run(batches):
        for batch in batches:
            rows = byte_texts(batch.column(1))
            for a, b in passes(rows):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(shared.value.score([t or b"" for t in rows[a:b]]), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, score double")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = (remainder("doc_id", MODULUS) == HELD).alias("held_out")
    return quality(docs, model).select("doc_id", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
