"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of template tokens: words in lower case without
punctuation, with numbers, capitalised names inside a sentence, and units after
a number replaced by the placeholders NUMBER, NAME and UNIT.  Digits joined by
``.`` or ``,`` are one number and neighbouring names are one name, so a new
value keeps the shape of the template.  Windows of eight template tokens, at
least half of them plain words, are hash-joined between documents and benchmark
items.  Where an item has fewer plain words in a window, or no more than one
window, windows of up to eight of its words are matched as they stand.  Along one
alignment of document and item the placeholders of all matched windows must bind
consistently: one item value to one document value and back.  An item that matches
with other values in its slots is a re-parameterised copy.

Only documents' windows whose fingerprint falls in a bitmap of the benchmark's
windows are shuffled; the bitmap has 32 bits for each window of the benchmark and
never more than 2 ** MOST_BITS.  The joins that follow are exact.  A window that many
items hold does not meet every document with every item: documents and items are
paired by the item's *rarest* windows, left over when the commonest that together
stay under the coverage asked for are set aside, and only those pairs are matched on all
windows.

Edge cases: null or empty texts hold no window and null ids take no part, on
either side; an item shorter than a window is matched as a whole, with new values in
its slots only if it has four plain words at least; an item without any plain
word is not matched; repeated rows of one id and text count once; empty tables
give an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinwright.llm.storage import checkpoint, hold, release
from joinwright.llm.textcore import Words, mix, signed, text_passes, window_hashes
from joinwright.llm.worker import tidy

WINDOW = 8
MIN_PLAIN = 4
#: Part of an item's tokens that one consistent alignment must cover.
MIN_COVERAGE = 0.5
#: Bounds of the bitmap's size, as powers of two.
LEAST_BITS, MOST_BITS = 16, 27

#: Units that may follow a number.
UNITS = """
km m cm mm mi mile miles ft feet foot inch inches yard yards
kg g mg lb lbs pound pounds ounce ounces oz ton tons tonne tonnes gram grams kilogram kilograms
l ml liter liters litre litres gallon gallons cup cups
s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years
dollar dollars cent cents euro euros usd eur percent degrees degree
meter meters metre metres kilometer kilometers kilometre kilometres mph kmh kph watt watts volt volts
""".split()

_U = np.uint64
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 256)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[10] = 10
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_BREAK = np.zeros(256, np.int64)
_BREAK[list(b".!?:;\n\"")] = 1
_PLACEHOLDER = mix(np.arange(101, 104, dtype=_U))
_UNIT_HASHES = np.sort(Words([u.encode() for u in UNITS]).hashes)


class Template:
    """Template tokens of several texts: fingerprints, slot values and token ranges by text."""

    def __init__(self, texts: list[bytes]):
        words = Words(texts, _FOLD)
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        starts, ends, text = words.starts, words.ends, words.text_of_word()
        n = len(starts)
        if not n:
            self.tokens = self.values = np.zeros(0, _U)
            self.plain = np.zeros(0, bool)
            self.first = np.zeros(len(texts) + 1, np.int64)
            self.words, self.word_first = self.values, self.first
            self.token_of = self.begin = np.zeros(0, np.int64)
            return
        one, two = raw[starts], raw[np.minimum(starts + 1, len(raw) - 1)]
        long = ends - starts
        number = _DIGIT[one]
        breaks = np.concatenate([[0], np.cumsum(_BREAK[raw])])
        opens = np.ones(n, bool)
        opens[1:] = (breaks[starts[1:]] > breaks[ends[:-1]]) | (text[1:] != text[:-1])
        capital = (one >= 65) & (one <= 90) & (long >= 2) & (((two >= 97) & (two <= 122)) | (two >= 0x80))
        capital |= (one == 0xC3) & (two >= 0x80) & (two <= 0x9E) & (long >= 3)
        name = capital & ~opens
        joint = np.zeros(n, bool)
        gap = raw[ends[:-1]]
        near = (starts[1:] - ends[:-1] == 1) & (text[1:] == text[:-1])
        joint[1:] = near & ((number[1:] & number[:-1] & ((gap == 46) | (gap == 44))) | (name[1:] & name[:-1] & (gap == 32)))
        kept = np.flatnonzero(~joint)
        self.words, self.word_first = words.hashes, words.first
        self.token_of, self.begin = np.cumsum(~joint) - 1, kept
        ends = ends[np.append(kept[1:], n) - 1]
        starts, number, name, text = starts[kept], number[kept], name[kept], text[kept]
        self.values = words.span_hashes(starts, ends)
        unit = np.zeros(len(kept), bool)
        known = _UNIT_HASHES[np.minimum(np.searchsorted(_UNIT_HASHES, self.values), len(_UNIT_HASHES) - 1)] == self.values
        unit[1:] = number[:-1] & known[1:] & (text[1:] == text[:-1])
        self.tokens = np.select([number, unit, name], list(_PLACEHOLDER), self.values)
        self.plain = ~(number | unit | name)
        self.first = np.searchsorted(text, np.arange(len(texts) + 1))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        at, hashes = window_hashes(self.tokens, self.first, k)
        plain = np.concatenate([[0], np.cumsum(self.plain)])
        enough = plain[at + k] - plain[at] >= min(MIN_PLAIN, k)
        return at[enough], mix(hashes[enough] + _U(k))

    def literals(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Word positions and fingerprints of the k-word windows of the words themselves."""
        at, hashes = window_hashes(self.words, self.word_first, k)
        return at, mix(hashes + _U(2 * WINDOW + k))

    def wanted_literals(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Literal windows that an item needs beside its template windows, and the first and last token each holds whole.

        Those with fewer than MIN_PLAIN plain words, and all of an item with one
        template window at most.  An item without a plain word has none.
        """
        at, hashes = self.literals(k)
        if not len(at):
            return at, hashes, at, at
        text = np.searchsorted(self.word_first, at, side="right") - 1
        counts = np.diff(self.word_first)[text]
        tokens = np.concatenate([[0], np.cumsum(self.plain)])
        some = (tokens[self.first[1:]] - tokens[self.first[:-1]])[text] > 0
        plain = np.concatenate([[0], np.cumsum(self.plain[self.token_of])])
        few = (plain[at + k] - plain[at] < MIN_PLAIN) | (np.diff(self.first)[text] <= WINDOW)
        low, high = self.token_of[at], self.token_of[at + k - 1]
        inside = low == high
        after = np.append(self.begin[1:], len(self.words))
        start = np.where(inside, low, low + (self.begin[low] != at))
        end = np.where(inside, high, high - (after[high] != at + k))
        use = (counts >= k if k == WINDOW else counts == k) & some & few & (start <= end)
        return at[use], hashes[use], start[use], end[use]

    def slots(self, at: int, k: int) -> list[int]:
        part = slice(at, at + k)
        return signed(self.values[part][~self.plain[part]]).tolist()


SCHEMA = "id bigint, print bigint, window bigint, k int, at int, low int, high int, n_tokens int, slots array<bigint>"


def _windows(texts: DataFrame, lengths: list[int] | None, bitmap: np.ndarray | None) -> DataFrame:
    """Template windows of (id, print, text).

    ``lengths`` None: benchmark side, where a text shorter than WINDOW is one
    window; else documents, with windows of these lengths that are in ``bitmap``.
    A literal window has its length in words as a negative k, and the position
    of its last token, as its first may be part of a longer name in the document.
    ``low`` to ``high`` are the item's tokens in the window.
    """
    shared = None if bitmap is None else texts.sparkSession.sparkContext.broadcast(bitmap)
    shift = None if bitmap is None else _U(64 - (8 * len(bitmap)).bit_length() + 1)

    def run(batches):
        bits = None if shared is None else shared.value
        for batch in batches:
            ids, prints = batch.column(0), batch.column(1)
            for a, _, rows in text_passes(batch.column(2)):
                template = Template([t or b"" for t in rows])
                sizes = np.diff(template.first)
                owner, win, ks, ats, lows, highs, slots = [], [], [], [], [], [], []
                for k in lengths or [*range(-WINDOW, 0), *range(MIN_PLAIN, WINDOW + 1)]:
                    if k > 0:
                        at, hashes = template.windows(k)
                        low, high = at, at + k - 1
                    elif bits is None:
                        at, hashes, low, high = template.wanted_literals(-k)
                        at = template.token_of[at - k - 1]
                    else:
                        at, hashes = template.literals(-k)
                        low = high = at = template.token_of[at - k - 1]
                    text = np.searchsorted(template.first, at, side="right") - 1
                    base = template.first[text]
                    if bits is not None:
                        place = (hashes >> shift).astype(np.int64)
                        hit = (bits[place >> 3] >> (place & 7)) & 1 > 0
                    else:
                        hit = (sizes[text] == k) if 0 < k < WINDOW else np.ones(len(at), bool)
                    at, hashes, text, low, high, base = at[hit], hashes[hit], text[hit], low[hit], high[hit], base[hit]
                    owner.append(text)
                    win.append(hashes)
                    ks.append(np.full(len(at), k, np.int32))
                    ats.append((at - base).astype(np.int32))
                    lows.append((low - base).astype(np.int32))
                    highs.append((high - base).astype(np.int32))
                    slots += [template.slots(x, y - x + 1) for x, y in zip(low, high, strict=True)]
                owner = np.concatenate(owner)
                take = pa.array(owner + a)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(take), prints.take(take), pa.array(signed(np.concatenate(win))), pa.array(np.concatenate(ks)), pa.array(np.concatenate(ats)), pa.array(np.concatenate(lows)), pa.array(np.concatenate(highs)), pa.array(sizes[owner].astype(np.int32)), pa.array(slots, pa.list_(pa.int64()))],
                    names=["id", "print", "window", "k", "at", "low", "high", "n_tokens", "slots"],
                )

    return texts.mapInArrow(tidy(run), SCHEMA)


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("print"), text.alias("text")).where("id IS NOT NULL AND text IS NOT NULL")


def _bitmap(windows: DataFrame) -> np.ndarray:
    """Bit set of the windows' top bits, as bytes; gathered in 64-bit lanes."""
    bits = min(MOST_BITS, max(LEAST_BITS, (32 * windows.count()).bit_length()))
    place = F.shiftrightunsigned("window", 64 - bits)
    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    lanes = windows.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("lane")).agg(F.bit_or(bit).alias("bits")).toArrow()  # 2 ** (bits - 6) rows at most
    out = np.zeros(1 << (bits - 6), np.int64)
    out[lanes.column("lane").to_numpy()] = lanes.column("bits").to_numpy()
    return out.view(np.uint8)


def _rarest(items: DataFrame, min_coverage: float) -> DataFrame:
    """(window, k, item_id, item_print): windows of which a document has at least one if it covers ``min_coverage`` of the item."""

    def keep(group: pd.DataFrame) -> pd.DataFrame:
        # the group is one item
        group = group.sort_values(["n_items", "window", "at"], ascending=[False, True, True])
        covered = np.zeros(int(group["n_tokens"].iat[0]), bool)
        aside = 0
        for n, low, high in zip(group["n_items"], group["low"], group["high"], strict=True):
            if n < 2:
                break
            covered[low : high + 1] = True
            if covered.sum() >= min_coverage * len(covered):
                break
            aside += 1
        return group.iloc[aside:][["window", "k", "id", "print"]]

    common = items.select("window", "k", "id", "print").distinct().groupBy("window", "k").agg(F.count("*").alias("n_items"))
    rated = items.join(common, ["window", "k"]).select("id", "print", "window", "k", "at", "low", "high", "n_tokens", "n_items")
    found = rated.groupBy("id", "print").applyInPandas(keep, "window bigint, k int, id bigint, print bigint").distinct()
    return hold(found.select("window", "k", F.col("id").alias("item_id"), F.col("print").alias("item_print")))


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_coverage: float = 0.0) -> DataFrame:
    """One row per document text, item and alignment (offset) that share a template window.

    Columns doc_id, print, item_id, item_print, offset, n_windows matched, covered
    (positions of the item's tokens), n_tokens of the item, n_slots (distinct item
    values bound), n_rebound (bound to another value), consistent.  Pairs that
    cover less than ``min_coverage`` of the item may be left out.
    """
    items = checkpoint(_windows(_texts(benchmark, item_col, item_text_col), None, None).distinct())
    lengths = sorted({r[0] for r in items.select("k").distinct().collect()})  # at most 2 * WINDOW values
    if not lengths:
        lengths = [WINDOW]
    found = checkpoint(_windows(_texts(docs, id_col, text_col), lengths, _bitmap(items)).distinct())
    near = _rarest(items, min_coverage)
    together = found.select(F.col("id").alias("doc_id"), "print", "window", "k").join(near, ["window", "k"]).select("doc_id", "print", "item_id", "item_print").distinct()
    i = items.select("window", "k", F.col("id").alias("item_id"), F.col("print").alias("item_print"), F.col("at").alias("item_at"), F.col("low").alias("item_low"), F.col("high").alias("item_high"), F.col("n_tokens").alias("item_tokens"), F.col("slots").alias("item_slots"))
    pairs = found.withColumnRenamed("id", "doc_id").join(together, ["doc_id", "print"]).join(i, ["item_id", "item_print", "window", "k"])
    pairs = checkpoint(
        pairs.select(
            "doc_id", "print", "item_id", "item_print", (F.col("at") - F.col("item_at")).alias("offset"), F.col("item_low").alias("low"), F.col("item_high").alias("high"), F.col("item_tokens").alias("n_tokens"),
            F.arrays_zip(F.col("item_slots").alias("item"), F.when(F.col("k") < 0, F.col("item_slots")).otherwise(F.col("slots")).alias("doc")).alias("slots"),
        )
    )
    release(items, found, near)
    key = ["doc_id", "print", "item_id", "item_print", "offset"]
    covered = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence("low", "high")))))
    runs = pairs.groupBy(*key, "n_tokens").agg(F.count("*").alias("n_windows"), covered.alias("covered"))
    bound = pairs.select(*key, F.explode("slots").alias("s")).select(*key, F.col("s.item").alias("item"), F.col("s.doc").alias("doc")).distinct()
    bound = bound.groupBy(*key).agg(
        F.countDistinct("item").alias("n_slots"), F.countDistinct("doc").alias("n_values"), F.count("*").alias("n_pairs"),
        F.countDistinct(F.when(F.col("item") != F.col("doc"), F.col("item"))).alias("n_rebound"),
    )
    out = runs.join(bound, key, "left")
    consistent = F.coalesce((F.col("n_pairs") == F.col("n_slots")) & (F.col("n_pairs") == F.col("n_values")), F.lit(True))
    return out.select(*key, "n_windows", "covered", "n_tokens", F.coalesce("n_slots", F.lit(0)).cast("bigint").alias("n_slots"), F.coalesce("n_rebound", F.lit(0)).cast("bigint").alias("n_rebound"), consistent.alias("consistent"))


def contaminated(docs: DataFrame, benchmark: DataFrame, min_coverage: float = MIN_COVERAGE, **names) -> DataFrame:
    """One row per document and item that it contains: doc_id, item_id, coverage, n_windows, n_slots, n_rebound, kind.

    An item counts when consistent alignments, which may be several where words
    were put in or left out, together cover ``min_coverage`` of its tokens; a
    token that several alignments cover counts once.  kind is ``verbatim``
    if no slot has a new value, else ``reparameterised``.
    """
    good = matches(docs, benchmark, min_coverage=min_coverage, **names).where("consistent")
    union = F.size(F.array_distinct(F.flatten(F.collect_set("covered"))))
    found = good.groupBy("doc_id", "print", "item_id", "item_print", "n_tokens").agg(F.sum("n_windows").alias("n_windows"), union.alias("n_covered"), F.sum("n_slots").alias("n_slots"), F.sum("n_rebound").alias("n_rebound"))
    best = found.withColumn("coverage", F.col("n_covered") / F.col("n_tokens")).where(F.col("coverage") >= min_coverage)
    top = F.max(F.struct("coverage", "n_windows", "n_slots", (-F.col("n_rebound")).alias("less"))).alias("t")
    rows = best.groupBy("doc_id", "item_id").agg(top)
    kind = F.when(F.col("t.less") == 0, F.lit("verbatim")).otherwise(F.lit("reparameterised"))
    return rows.select("doc_id", "item_id", "t.coverage", "t.n_windows", "t.n_slots", (-F.col("t.less")).alias("n_rebound"), kind.alias("kind"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the ids that contain a benchmark item; columns unchanged."""
    gone = contaminated(docs, benchmark, id_col=id_col, **options).select(F.col("doc_id").alias("__gone")).distinct()
    key = docs[id_col].cast("bigint")
    # rows without an id hold nothing, and do not meet in one task
    return docs.where(key.isNotNull()).join(gone, key == gone["__gone"], "left_anti").unionByName(docs.where(key.isNull()))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
