"""Quality rules from suffix-array repetition inside each document.

Words that lie in an 8-word window found twice or more in the same text are the
only ones a longer repeat can use, so a suffix array is built over those runs
alone (prefix doubling over word ranks, all texts of a pass at once).  Longest
common prefixes of neighbouring suffixes give the maximal repeated substrings;
their spans are united, and a document is rejected when the united spans cover
too many of its words' characters (the base rule counts words) or a single repeat
is too long.

Edge cases: a null or empty text has no words, so it fails the base rule
``n_words < 20``; repeated rows are judged one by one and get equal verdicts;
an empty table gives an empty table; other columns, null ids included, pass
through unchanged.  A very long text is a pass of its own, with a fixed number of
arrays as long as its words and, in the suffix array, as its repeated words.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from joinwright.llm.textcore import Spans, Words, annotate, mix

MIN_WORDS = 20
WINDOW = 8
MAX_COVERED_PERCENT = 30
#: A document with one repeat of more words than this is rejected.
MAX_LONGEST = 150

_U = np.uint64
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_STARTS_CHAR = (np.arange(256) & 0xC0) != 0x80

FIELDS = [(n, "bigint") for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "covered_chars", "longest_repeat", "n_repeats")]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Marks the elements whose value occurs twice or more."""
    order = np.argsort(keys)
    same = np.diff(keys[order]) == 0
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _cover(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Marks positions inside any span [start, start + length)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + lengths, -1)
    return np.cumsum(step[:-1]) > 0


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks of key tuples, the first key most significant."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= np.diff(k[order]) != 0
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


class SuffixArray:
    """Suffix array of several strings at once, with neighbour LCPs.

    ``symbols`` holds the strings end to end, ``string`` the number of each
    position's string.  Symbols of different groups must differ.  Suffixes end
    with their string, and no suffix matches past such an end.
    """

    def __init__(self, symbols: np.ndarray, string: np.ndarray):
        n = len(symbols)
        ends = np.searchsorted(string, string, side="right")
        rank, k = _dense(symbols), 1
        longest = int((ends - np.arange(n)).max(initial=0))
        while k < longest and rank.max(initial=-1) + 1 < n:
            at = np.arange(n) + k
            rank = _dense(rank, np.where(at < ends, rank[np.minimum(at, n - 1)], -1 - string))
            k *= 2
        self.order = np.argsort(rank, kind="stable")
        left, right = self.order[:-1].copy(), self.order[1:].copy()
        room = np.minimum(ends[left] - left, ends[right] - right)
        # fingerprints of spans of any length come from one running sum
        spans = Spans(mix(symbols.astype(_U) + _U(1)))
        lcp = np.zeros(max(n - 1, 0), np.int64)
        step = 1 << max(longest - 1, 0).bit_length()
        while step:
            at = np.flatnonzero(lcp + step <= room)
            i, j = left[at] + lcp[at], right[at] + lcp[at]
            lcp[at[spans(i, i + step) == spans(j, j + step)]] += step
            step //= 2
        self.lcp = lcp


def repetition(words: Words, window: int = WINDOW) -> list[np.ndarray]:
    """Per text: words in repeated windows, words and characters covered by maximal repeats, longest repeat, number of LCP intervals."""
    n_texts = len(words.counts)
    out = [np.zeros(n_texts, np.int64) for _ in range(5)]
    text = words.text_of_word()
    at, hashes = words.windows(window)
    if not len(at):
        return out
    twice = at[_repeated(mix(hashes + mix(text[at].astype(_U) + _U(1))))]
    if not len(twice):
        return out
    marked = _cover(len(text), twice, np.full(len(twice), window))
    out[0] = np.bincount(text[marked], minlength=n_texts)
    place = np.flatnonzero(marked)
    where = text[place]
    run = np.cumsum(np.diff(place, prepend=-2) != 1) + np.cumsum(np.diff(where, prepend=-1) != 0)
    suffixes = SuffixArray(_dense(where, words.hashes[place]), run)
    order, lcp = suffixes.order, suffixes.lcp
    best = np.zeros(len(order), np.int64)
    np.maximum.at(best, order[:-1], lcp)
    np.maximum.at(best, order[1:], lcp)
    long = best >= window
    union = _cover(len(place), np.flatnonzero(long), best[long])
    out[1] = np.bincount(where[union], minlength=n_texts)
    chars = np.cumsum(np.append(0, words.inside & _STARTS_CHAR[words.buf]))
    size = (chars[words.ends] - chars[words.starts])[place[union]]
    np.add.at(out[2], where[union], size)
    np.maximum.at(out[3], where, np.where(long, best, 0))
    # an interval opens where the LCP rises to the window or above it
    rise = (lcp >= window) & (lcp > np.concatenate([[0], lcp[:-1]]))
    out[4] = np.bincount(where[order[1:]][rise], minlength=n_texts)
    return out


def measure(texts: list[bytes | None]) -> list[np.ndarray]:
    """The counts named in FIELDS for each text."""
    words = Words([t or b"" for t in texts])
    begin = words.begin[:-1]
    chars = np.add.reduceat((words.inside & _STARTS_CHAR[words.buf]).astype(np.int64), begin)
    symbols = np.add.reduceat(_SYMBOL[words.buf], begin)
    line_ends = np.flatnonzero(words.buf == 10)
    line_starts = np.concatenate([[0], line_ends[:-1] + 1])
    filled = np.searchsorted(words.starts, line_ends) > np.searchsorted(words.starts, line_starts)
    line_starts, line_ends = line_starts[filled], line_ends[filled]
    line_text = np.searchsorted(words.begin, line_starts, side="right") - 1
    lines = np.bincount(line_text, minlength=len(texts))
    keys = mix(words.span_hashes(line_starts, line_ends) + mix(line_text.astype(_U) + _U(1)))
    _, firsts = np.unique(keys, return_index=True)
    distinct = np.bincount(line_text[firsts], minlength=len(texts))
    return [words.counts, chars, symbols, lines - distinct, *repetition(words)]


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (n_repeat_words * 100 > n_words * MAX_COVERED_PERCENT)


def quality_rules(docs: DataFrame, text_col: str = "text", into: str = "quality_rules") -> DataFrame:
    """Adds struct ``into`` with the counts of FIELDS, ``base_failed`` and ``kept``; a column of that name is replaced."""
    df = annotate(docs, text_col, measure, FIELDS, into)
    q = F.col(into)
    failed = base_failed(q["n_words"], q["n_repeat_words"])
    kept = ~failed & (q["covered_chars"] * 100 <= q["word_chars"] * MAX_COVERED_PERCENT) & (q["longest_repeat"] <= MAX_LONGEST)
    return df.withColumn(into, q.withField("base_failed", failed).withField("kept", kept))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    q = F.col("quality_rules")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_rules(docs).select("doc_id", *(q[n].alias(n) for n in names))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
win AS (
  SELECT doc_id, i, hash(list_slice(w, i, i + {WINDOW - 1})) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, h) > 1),
cov AS (
  SELECT doc_id, count(*) AS n, sum(length(w[p])) AS c
  FROM (SELECT DISTINCT doc_id, i + j AS p FROM rep, range(0, {WINDOW}) r(j)) JOIN d USING (doc_id) GROUP BY doc_id),
far AS (
  SELECT DISTINCT doc_id FROM (
    SELECT doc_id, list_slice(w, i, i + {MAX_LONGEST}) AS s
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - {MAX_LONGEST - 1})) AS i FROM d JOIN cov USING (doc_id)
          WHERE len(w) > {MAX_LONGEST} AND cov.n > {MAX_LONGEST}))
  GROUP BY doc_id, hash(s) HAVING count(*) > 1),
ln AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
b AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(ln.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
    far.doc_id IS NOT NULL OR 100 * coalesce(cov.c, 0) > {MAX_COVERED_PERCENT} * length(array_to_string(w, '')) AS too_much
  FROM d LEFT JOIN ln USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN far USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_COVERED_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_COVERED_PERCENT} * n_words OR too_much) AS kept
FROM b
"""
