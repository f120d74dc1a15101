"""Passages that repeat across the corpus, found with a sparse suffix array.

Of all word suffixes of the corpus only those at *minimiser* positions are
retained: in every window of ``min_words`` words, the position whose 16-word
gram has the smallest fingerprint.  Equal windows retain the same position, so
two texts that share ``min_words`` words share a retained suffix.

1. The retained suffixes are sorted by their gram and by all words that their
   windows reach, left and right, then by (id, text print, position), over all partitions
   (``runs``), and neighbours are compared.  A suffix that equals its neighbour
   over its whole reach repeats the first of their run.
2. Where neighbours share the gram but not the reach, the first suffix of each
   run is extended word by word: its windows, from the one that begins
   furthest to the left to the one that ends furthest to the right, are suffixes
   of their own, sorted by their words and compared with their neighbours again.

Neither step gathers a passage's copies in one task or forms a pair of them.
Words are compared by 128-bit cryptographic digests of the words themselves,
joined by single spaces; fingerprints of 64 bits only choose and order.

A window counts as repeated when an equal window starts earlier in the order
(id, text print, position).  Repeated windows of a text that overlap or
touch are united into spans.  The earliest copy is never marked.

Edge cases: null or empty texts and texts under ``min_words`` words have no
span; rows with a null id take no part and are never cut; repeated rows (same id
and text) count as one document; an id with several texts has spans for each
text; words may be separated by any white space; an empty table gives an empty
table; other columns are not read, and ``remove_repeats`` passes them through.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from joinwright.llm.runs import HEAD, sorted_runs
from joinwright.llm.storage import checkpoint, few_files, hold, release
from joinwright.llm.textcore import WHITESPACE, Words, signed, text_passes, window_hashes
from joinwright.llm.worker import tidy

MIN_WORDS = 50
GRAM = 16

_U = np.uint64


def minimisers(grams: np.ndarray, width: int) -> np.ndarray:
    """For each start of ``width`` grams, the leftmost position of the smallest."""
    best, span = np.arange(len(grams)), 1
    while span < width:
        step = min(span, width - span)
        left, right = best[:-step], best[step:]
        best = np.where(grams[left] <= grams[right], left, right)
        span += step
    return best


class Digests:
    """128-bit digests of word ranges: of the words joined by single spaces."""

    def __init__(self, words: Words):
        # of the white space behind a word, its first byte stays
        keep = words.inside.copy()
        keep[1:] |= words.inside[:-1]
        place = np.cumsum(keep) - 1
        text = words.buf[keep]
        self.text = np.where(WHITESPACE[text], np.uint8(32), text).tobytes()
        self.starts, self.ends = place[words.starts], place[words.ends - 1] + 1

    def of(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both halves of the digests of the words first..last - 1."""
        text = self.text
        found = b"".join([blake2b(text[a:b], digest_size=16).digest() for a, b in zip(self.starts[first].tolist(), self.ends[last - 1].tolist(), strict=True)])
        halves = np.frombuffer(found, np.int64).reshape(-1, 2)
        return halves[:, 0], halves[:, 1]


def anchors(words: Words, min_words: int) -> tuple[np.ndarray, ...]:
    """Retained suffixes: text, gram, both halves of the digest of their reach, first window start in the text, number of windows."""
    last = np.repeat(words.first[1:], words.counts) - min_words
    starts = np.flatnonzero(np.arange(len(words.hashes)) <= last)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 6
    every, grams = window_hashes(words.hashes, np.array([0, len(words.hashes)]), GRAM)
    at = minimisers(grams, min_words - GRAM + 1)[starts]
    text = np.searchsorted(words.first, starts, side="right") - 1
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(at) != 0) | (np.diff(text) != 0)
    lo = starts[new]
    count = np.diff(np.append(np.flatnonzero(new), len(starts)))
    at, text = at[new], text[new]
    return text, signed(grams[at]), *Digests(words).of(lo, lo + count - 1 + min_words), lo - words.first[text], count


RUNS_SCHEMA = "k0 bigint, k1 bigint, k2 bigint, o0 bigint, o1 bigint, o2 bigint, payload bigint"
_NAMES = [x.split()[0] for x in RUNS_SCHEMA.split(", ")]


def _retained(docs: DataFrame, min_words: int) -> DataFrame:
    """Every retained suffix, to be sorted by gram and digest, with its number of windows."""

    def run(batches):
        for batch in batches:
            ids, prints = batch.column(0), batch.column(1)
            for a, _, texts in text_passes(batch.column(2)):
                words = Words([t or b"" for t in texts])
                text, gram, one, two, lo, n = anchors(words, min_words)
                rows = pa.array(text + a)
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(one), pa.array(two), ids.take(rows), prints.take(rows), pa.array(lo), pa.array(n)], names=_NAMES)

    return docs.select("doc_id", "print", "text").mapInArrow(tidy(run), RUNS_SCHEMA)


def _windows(docs: DataFrame, min_words: int) -> DataFrame:
    """Every window of the suffixes in the array ``parts`` of (lo, n), to be sorted by its digest, with that suffix's lo."""

    def run(batches):
        for batch in batches:
            parts = batch.column(3)
            for a, b, texts in text_passes(batch.column(2)):
                words = Words([t or b"" for t in texts])
                part = parts.slice(a, b - a)
                rows = np.repeat(np.arange(b - a), np.asarray(part.value_lengths()))
                flat = part.flatten()
                lo, n = (np.asarray(flat.field(k)).astype(np.int64) for k in (0, 1))
                each = np.repeat(np.arange(len(lo)), n)
                at = lo[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                begin = words.first[rows[each]] + at
                one, two = Digests(words).of(begin, begin + min_words)
                take = pa.array(rows[each] + a)
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(np.zeros(len(at), np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(at), pa.array(lo[each])], names=_NAMES)

    return docs.select("doc_id", "print", "text", "parts").mapInArrow(tidy(run), RUNS_SCHEMA)


def _united(spans: DataFrame) -> DataFrame:
    """(doc_id, print, spans) from (doc_id, print, start_word, end_word, source_doc_id): overlapping and touching spans become one."""
    text = ["doc_id", "print"]
    by_start = W.partitionBy(*text).orderBy("start_word")
    before = F.max("end_word").over(by_start.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(F.col("start_word") <= before, 0).otherwise(1)
    islands = spans.withColumn("opens", opens).withColumn("island", F.sum("opens").over(by_start.rowsBetween(W.unboundedPreceding, 0)))
    one = islands.groupBy(*text, "island").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.min("source_doc_id").alias("source_doc_id"))
    return one.groupBy(*text).agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word", "source_doc_id"))).alias("spans"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, print, spans): per text, its united spans that repeat an earlier passage.

    ``print`` is xxhash64 of the text.  A span covers words start_word to
    end_word - 1, counted from 0; source_doc_id is the smallest id that holds the
    earliest copy of a window of it.
    """
    if min_words < GRAM:
        raise ValueError(f"min_words must be at least {GRAM}")
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    docs = docs.withColumn("print", F.xxhash64("text"))
    retained = checkpoint(_retained(docs, min_words))
    suffixes, suffix_table = sorted_runs(retained)
    release(retained)

    firsts = suffixes.where("varied").select(F.col("h0").alias("doc_id"), F.col("h1").alias("print"), F.col("h2").alias("lo"), F.col("payload").alias("n")).distinct()
    parts = firsts.groupBy("doc_id", "print").agg(F.collect_list(F.struct("lo", "n")).alias("parts"))
    texts = docs.join(parts, ["doc_id", "print"]).dropDuplicates(["doc_id", "print"])
    extended = checkpoint(_windows(texts, min_words).coalesce(few_files(docs.sparkSession)))
    windows, window_table = sorted_runs(extended)
    release(extended)

    later = windows.where("copy").select(F.col("o0").alias("doc_id"), F.col("o1").alias("print"), F.col("o2").alias("at"), F.col("payload").alias("lo"), F.col("h0").alias("source"))
    sources = hold(later.groupBy("doc_id", "print", "lo").agg(F.min("source").alias("source")).select(F.col("doc_id").alias("h0"), F.col("print").alias("h1"), F.col("lo").alias("h2"), "source"))
    copies = suffixes.where("copy").select("o0", "o1", "o2", "payload", *HEAD, "part")
    # a passage has copies in as many parts of the sorted table as they need, and they get their source part by part
    known = copies.select("part", *HEAD).distinct().join(sources, [*HEAD])
    copies = copies.join(known, ["part", *HEAD], "left")

    def span(start: str, length: Column, source: Column) -> list[Column]:
        start = F.col(start)
        return [start.cast("int").alias("start_word"), (start + length).cast("int").alias("end_word"), source.alias("source_doc_id")]

    whole = copies.select(F.col("o0").alias("doc_id"), F.col("o1").alias("print"), *span("o2", F.col("payload") - 1 + min_words, F.least("h0", "source")))
    single = later.select("doc_id", "print", *span("at", F.lit(min_words), F.col("source")))
    found = checkpoint(whole.unionByName(single).coalesce(few_files(docs.sparkSession)))
    release(suffix_table, window_table, sources)
    return _united(found)


_SPACE = r"[\x20\x09-\x0D]"


def _without(text: Column, spans: Column) -> Column:
    """The text without the words of the spans and the white space behind them."""
    lead = F.regexp_extract(text, f"^{_SPACE}*", 0)
    # each word with the white space behind it
    words = F.split(F.substr(text, F.char_length(lead) + 1), f"(?<={_SPACE})(?=[^\\x20\\x09-\\x0D])")
    starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end_word"]))
    ends = F.concat(F.transform(spans, lambda s: s["start_word"]), F.array(F.size(words)))
    kept = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda g: F.array_join(F.slice(words, g["a"] + 1, F.greatest(g["b"] - g["a"], F.lit(0))), ""))
    return F.concat(lead, F.array_join(kept, ""))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated spans cut from the text; every row and column stays."""
    taken = {c.lower() for c in docs.columns}
    names = []
    for name in ("__id", "__print", "__spans"):
        while name.lower() in taken:
            name += "_"
        names.append(name)
    found = repeated_passages(docs, id_col, text_col, min_words).select(*(F.col(c).alias(n) for c, n in zip(("doc_id", "print", "spans"), names, strict=True)))
    joined = docs.join(found, (docs[id_col].cast("bigint") == F.col(names[0])) & (F.xxhash64(docs[text_col].cast("string")) == F.col(names[1])), "left")
    text, spans = F.col(f"`{text_col}`"), F.col(names[2])
    return joined.withColumn(text_col, F.when(spans.isNull(), text).otherwise(_without(text.cast("string"), spans))).select(*(F.col(f"`{c}`") for c in docs.columns))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per span that repeats an earlier passage of 50 words or more."""
    spans = repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = spans.select("doc_id", F.explode("spans").alias("s"))
    return rows.select("doc_id", "s.source_doc_id", "s.start_word", "s.end_word", (F.col("s.end_word") - F.col("s.start_word")).alias("n_words"))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (
  SELECT doc_id, i, hash(list_slice(w, i + 1, i + {MIN_WORDS})) AS h
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - {MIN_WORDS - 1})) AS i FROM d WHERE len(w) >= {MIN_WORDS})),
firsts AS (SELECT doc_id, i, first_value(doc_id) OVER (PARTITION BY h ORDER BY doc_id, i) AS sd, first_value(i) OVER (PARTITION BY h ORDER BY doc_id, i) AS si FROM win),
later AS (SELECT doc_id, i, sd FROM firsts WHERE (doc_id, i) <> (sd, si)),
cutp AS (SELECT doc_id, i, sd, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {MIN_WORDS} THEN 0 ELSE 1 END AS fresh FROM later),
isl AS (SELECT doc_id, i, sd, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM cutp)
SELECT doc_id, min(sd) AS source_doc_id, CAST(min(i) AS INTEGER) AS start_word, CAST(max(i) + {MIN_WORDS} AS INTEGER) AS end_word, CAST(max(i) + {MIN_WORDS} - min(i) AS INTEGER) AS n_words
FROM isl GROUP BY doc_id, g
"""
