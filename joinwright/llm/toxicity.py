"""Toxicity by weak supervision.

1. *Voters.*  From a bounded sample of labelled rows, words and word beginnings
   (4 to 6 bytes) that occur mostly in toxic texts become lexicon voters, one
   each; fixed patterns (shouting, exclamation marks, symbols, very short text)
   and the absence of every lexicon voter vote too.  A voter votes or abstains,
   and only votes are evidence.
2. *Label model.*  A generative model with the unknown label as latent variable
   estimates by EM each voter's rate of voting given either label (its accuracy)
   and, from the residuals, the correlations between voters given the label.
   Correlated voters share their evidence: a voter's log-likelihood ratio is
   divided by one plus the sum of its correlations with the others.
3. *Classifier.*  A linear classifier is trained on the posterior labels, over
   the votes and the number of lexicon hits, and scores every whole text.

Labels come only from rows outside the held-out fold.  What the fit sees is bounded
by parameters: ``SAMPLE`` labelled rows, the ``MAX_CANDIDATES`` terms of most
evidence in them, and of these the ``MAX_VOTERS`` that tell something new.  Terms
are counted on the executors; the driver gets the candidates' counts and, of each
sampled text, which candidates it holds.  Scoring covers all rows and whole texts.

Edge cases: null and empty texts are scored by the classifier with no votes;
without usable labels every score is 0; repeated rows get equal scores; rows with
a null id are scored; empty tables give an empty table; other columns are not
read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinwright.llm.folds import labelled_sample, remainder, sampled_texts
from joinwright.llm.storage import checkpoint, release
from joinwright.llm.textcore import WHITESPACE, Words, byte_texts, mix, passes, signed

SAMPLE = 8000
MODULUS, HELD = 4, 2
THRESHOLD = 0.3
PREFIXES = (4, 5, 6)
MAX_VOTERS = 400
MAX_CANDIDATES = 3000
#: A candidate whose sampled texts lie to this part inside an accepted voter's adds nothing.
REDUNDANT = 0.95
#: A lexicon voter occurs in this many sampled toxic texts at least, and in this part of them.
MIN_DOCS = 4
MIN_PART = 0.006
#: A lexicon voter occurs this many times as often in toxic texts.
MIN_RATIO = 60.0

_U = np.uint64
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[39] = 39
_FOLD[10] = 10
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_LOWER = np.zeros(256, np.int64)
_LOWER[97:123] = 1
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
PATTERNS = ("shouting", "exclaiming", "symbols", "short")


def terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the words and word beginnings of the texts, and their texts' numbers."""
    words = Words(texts, _FOLD)
    text = words.text_of_word()
    long = words.ends - words.starts
    keys, owners = [words.hashes[long >= 3]], [text[long >= 3]]
    for k in PREFIXES:
        has = long >= k
        keys.append(mix(words.span_hashes(words.starts[has], words.starts[has] + k) + _U(k)))
        owners.append(text[has])
    return np.concatenate(keys), np.concatenate(owners)


def patterns(texts: list[bytes]) -> np.ndarray:
    """Votes of the pattern voters, a row for each text."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])[:-1]
    upper, lower, symbols, marks, blank = (np.add.reduceat(table[raw], begin) for table in (_UPPER, _LOWER, _SYMBOL, (np.arange(256) == 33).astype(np.int64), WHITESPACE.astype(np.int64)))
    return np.stack([upper > lower, marks * 40 > blank + 20, symbols * 10 > blank + 20, blank <= 20], axis=1)


@dataclass
class Model:
    """Sorted lexicon fingerprints and the classifier's weights: lexicon, hits, patterns, bias."""

    lexicon: np.ndarray
    weights: np.ndarray

    def features(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Lexicon hit counts by text and the dot product of present voters and their weights."""
        keys, owners = terms(texts)
        n, m = len(texts), len(self.lexicon)
        hits, dots = np.zeros(n), np.zeros(n)
        if m and len(keys):
            at = np.searchsorted(self.lexicon, keys)
            at[at == m] = 0
            hit = self.lexicon[at] == keys
            pairs = np.unique(owners[hit].astype(np.int64) * m + at[hit])
            hits = np.bincount(owners[hit], minlength=n).astype(float)
            dots = np.bincount(pairs // m, weights=self.weights[pairs % m], minlength=n)
        return hits, dots

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not len(self.weights):
            return np.zeros(len(texts))
        hits, dots = self.features(texts)
        m = len(self.lexicon)
        z = dots + np.log1p(hits) * self.weights[m] + patterns(texts) @ self.weights[m + 1 : -1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of label 1 for each row, the voters' rates given labels 0 and 1, and their correlations.

    ``votes`` is a 0/1 matrix (0: the voter abstains), ``start`` the first
    posterior.
    """
    posterior = np.clip(start, 0.02, 0.98)
    n, m = votes.shape
    rates, corr = np.zeros((2, m)), np.zeros((m, m))
    for _ in range(rounds):
        weight = np.stack([1 - posterior, posterior])
        rates = (weight @ votes + 0.02) / (weight.sum(axis=1, keepdims=True) + 1.0)
        # residuals given the expected label; their correlations, positive part only
        residual = votes - (weight.T @ rates)
        sd = np.sqrt((residual**2).mean(axis=0) + 1e-9)
        corr = np.clip((residual.T @ residual) / n / np.outer(sd, sd), 0, 1)
        np.fill_diagonal(corr, 0)
        corr[corr < 0.1] = 0
        evidence = np.log(rates[1] / rates[0]) / (1 + corr.sum(axis=1))
        prior = np.clip(posterior.mean(), 1e-3, 1 - 1e-3)
        z = np.log(prior / (1 - prior)) + votes @ evidence
        posterior = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return posterior, rates, corr


def accepted(votes: np.ndarray) -> list[int]:
    """The voters, at most MAX_VOTERS, whose texts do not lie inside those of an accepted one before them."""
    together = votes.T @ votes
    chosen: list[int] = []
    for c in range(votes.shape[1]):
        if len(chosen) < MAX_VOTERS and not (together[c, chosen] >= REDUNDANT * together[c, c]).any():
            chosen.append(c)
    return chosen


def fit(keys: np.ndarray, held: list[np.ndarray], extra: np.ndarray) -> Model:
    """Chooses the lexicon, runs the label model, trains the classifier.

    ``keys`` are the candidates' fingerprints, most evidence first, ``held`` each
    sampled text's candidates and ``extra`` its pattern votes.
    """
    votes = np.zeros((len(held), len(keys)), np.float32)
    votes[np.repeat(np.arange(len(held)), list(map(len, held))), np.concatenate([*held, np.zeros(0, np.int64)]).astype(np.int64)] = 1
    chosen = np.array(accepted(votes), np.int64)
    chosen = chosen[np.argsort(keys[chosen])]
    votes, lexicon = votes[:, chosen].astype(float), keys[chosen]
    hits = votes.sum(axis=1)
    # the patterns' rates are learned too, so one that does not speak for label 1 gets no say
    posterior, _, _ = label_model(np.hstack([votes, extra, hits[:, None] == 0]), np.where(hits > 0, 0.9, 0.05))
    x = np.hstack([votes, np.log1p(hits)[:, None], extra, np.ones((len(held), 1))])
    return Model(lexicon, _logistic(x, posterior))


def _logistic(x: np.ndarray, target: np.ndarray, penalty: float = 0.3, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression on soft labels by Newton steps."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - target) + ridge * w
        curve = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, gradient)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-5:
            break
    return w


def _distinct(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every text's distinct terms: fingerprints and text numbers, by text."""
    keys, owners = terms(texts)
    order = np.lexsort((keys, owners))
    keys, owners = keys[order], owners[order]
    new = np.ones(len(keys), bool)
    new[1:] = (np.diff(keys) != 0) | (np.diff(owners) != 0)
    return keys[new], owners[new]


def _counts(texts: DataFrame) -> DataFrame:
    """(key, positive, total): sampled texts with each term, and those of label 1; the null key counts all texts."""

    def run(batches):
        for batch in batches:
            rows, labels = byte_texts(batch.column(0)), batch.column(1).to_numpy()
            for a, b in passes(rows):
                keys, owners = _distinct([t or b"" for t in rows[a:b]])
                found, of = np.unique(keys, return_inverse=True)
                y = labels[a:b]
                total, positive = np.bincount(of, minlength=len(found)), np.bincount(of, weights=y[owners], minlength=len(found)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([*signed(found).tolist(), None], pa.int64()), pa.array(np.append(positive, y.sum())), pa.array(np.append(total, b - a))], names=["key", "positive", "total"])

    parts = texts.select("text", "y").mapInArrow(run, "key bigint, positive bigint, total bigint")
    return checkpoint(parts.groupBy("key").agg(F.sum("positive").alias("positive"), F.sum("total").alias("total")))


def candidates(counts: DataFrame) -> np.ndarray:
    """Fingerprints of the MAX_CANDIDATES terms that speak most for label 1, best first; none without both labels."""
    all_ = counts.where("key IS NULL").first()
    if not all_ or not 0 < all_["positive"] < all_["total"]:
        return np.zeros(0, _U)
    n1, n0 = all_["positive"], all_["total"] - all_["positive"]
    in_toxic, in_clean = (F.col("positive") + 0.05) / (n1 + 1), (F.col("total") - F.col("positive") + 0.05) / (n0 + 1)
    good = counts.where(F.col("key").isNotNull() & (F.col("positive") >= max(MIN_DOCS, MIN_PART * n1)) & (in_toxic >= MIN_RATIO * in_clean))
    best = good.orderBy((F.col("positive") * F.ln(in_toxic / in_clean)).desc(), "key").limit(MAX_CANDIDATES).select("key").collect()
    return np.array([r[0] for r in best], np.int64).view(_U)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits the model on at most ``sample`` labelled rows outside the held-out fold."""
    texts = sampled_texts(docs, labelled_sample(labels, "toxic", MODULUS, HELD, sample))
    counts = _counts(texts)
    keys = candidates(counts)
    both = counts.where("key IS NULL AND positive > 0 AND positive < total").count() > 0
    release(counts)
    if not both:
        return Model(np.zeros(0, _U), np.zeros(0))
    order = np.argsort(keys)
    shared = docs.sparkSession.sparkContext.broadcast((keys[order], order.astype(np.int16)))  # MAX_CANDIDATES fingerprints at most

    def run(batches):
        known, place = shared.value
        for batch in batches:
            rows = byte_texts(batch.column(1))
            for a, b in passes(rows):
                part = [t or b"" for t in rows[a:b]]
                found, owners = _distinct(part)
                at = np.minimum(np.searchsorted(known, found), max(len(known) - 1, 0))
                hit = known[at] == found if len(known) else np.zeros(len(found), bool)
                cuts = np.searchsorted(owners[hit], np.arange(len(part) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(cuts), pa.array(place[at[hit]], pa.int16())), pa.array(patterns(part).tolist(), pa.list_(pa.bool_()))],
                    names=["doc_id", "terms", "patterns"],
                )

    found = texts.select("doc_id", "text").mapInArrow(run, "doc_id bigint, terms array<smallint>, patterns array<boolean>").toArrow().sort_by("doc_id")
    lists = found.column("terms").combine_chunks()
    flat, cuts = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    return fit(keys, [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], np.array(found.column("patterns").to_pylist(), float))


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, lexicon_hits) for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_VOTERS fingerprints and weights

    def run(batches):
        scorer = shared.value
        for batch in batches:
            rows = byte_texts(batch.column(1))
            for a, b in passes(rows):
                part = [t or b"" for t in rows[a:b]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(scorer.score(part))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, score double")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = (remainder("doc_id", MODULUS) == HELD).alias("held_out")
    return toxicity(docs, model).select("doc_id", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
