"""Near-duplicate documents: MinHash bands, odd-sketch verification, exact confirmation.

1. Equal shingle sets collapse to one representative (the smallest id), the first
   of a run of equal set fingerprints in a sorted table (``runs``).
2. Each representative gets MinHash values, cut into bands, and an *odd sketch*:
   the one-permutation MinHash samples (bin, minimum) are folded into a parity
   bitmap, so the population count of two bitmaps' XOR estimates how many
   samples differ.  Near the threshold few samples differ and the estimate is
   sharp.
3. Members of a band bucket are paired with the smallest member of their bucket
   and with the one before them in it (a star and a chain, never all pairs); the odd
   sketch, in small sets a bitmap of all shingles, drops pairs that cannot reach
   the threshold, and the remaining pairs are confirmed on full shingle sets.
4. Buckets that these links have not joined into one component are searched
   block by block: members of *different* components whose odd sketches agree
   are confirmed on full sets too, so no link between components is lost to the
   star shortcut.
5. Confirmed links give components by large-star/small-star rounds.

The number of bands is chosen so that a pair at the threshold shares no band
with probability below 1e-5.  Nothing is collected to the driver.  Buckets are
runs of a sorted table, and sides that are aggregated by bucket or hub are kept
apart, so that a bucket, a hub or a group of copies with a third of all rows
is split over many tasks.

Edge cases: null or empty texts and texts without words have the empty set, are
linked with nothing and kept; fewer words than a shingle give one shingle of the
whole sequence; rows with a null id are never linked and always kept
(component null); repeated rows of one id get equal results, and where an id
comes with different texts each text links that id; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinwright.llm.components import components
from joinwright.llm.runs import sorted_runs
from joinwright.llm.sieve import Sieve
from joinwright.llm.storage import checkpoint, few_files, hold, release
from joinwright.llm.textcore import ASCII_LOWER, IDENTITY, Words, mix, passes, signed, text_passes, window_hashes
from joinwright.llm.worker import tidy

ROWS = 4
BINS = 1024
SKETCH_BITS = 2048
LANES = SKETCH_BITS // 64
#: The sketch estimate may be this many standard deviations under the threshold.
DEVIATIONS = 5.0
#: Pairs with this many shingles together, or fewer, are dropped by a bound that no link breaks.
SMALL = 1024
#: A bucket of n members that is not yet one component is dealt to blocks of 8 * sqrt(n) members, within these bounds.
LEAST_BLOCK, MOST_BLOCK = 256, 2048

_U = np.uint64


def bands_for(threshold: float, rows: int = ROWS, miss: float = 1e-5) -> int:
    """Bands so that a pair at the threshold shares none with probability under ``miss``."""
    return math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))


def shingle_sets(texts: list[bytes | None], size: int, fold_case: bool) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingles of each text."""
    for a, b in passes(texts):
        words = Words([t or b"" for t in texts[a:b]], ASCII_LOWER if fold_case else IDENTITY)
        at, grams = words.windows(size)
        bounds = np.searchsorted(at, words.first)
        for i, n in enumerate(words.counts):
            if n >= size:
                x = np.sort(grams[bounds[i] : bounds[i + 1]])
                yield x[np.concatenate([[True], x[1:] != x[:-1]])]
            elif n:
                part = words.hashes[words.first[i] : words.first[i + 1]]
                yield window_hashes(part, np.array([0, n]), int(n))[1]
            else:
                yield np.zeros(0, _U)


class Signer:
    """MinHash band keys and odd sketches of shingle sets."""

    def __init__(self, bands: int, rows: int = ROWS):
        draw = np.random.default_rng(20240229)
        self.bands, self.rows = bands, rows
        self.scale = draw.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)
        self.shift = draw.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
        self.band_number = mix(np.arange(1, bands + 1, dtype=_U))

    def band_keys(self, shingles: np.ndarray) -> np.ndarray:
        x = shingles.astype(np.uint32)
        least = np.full(len(self.scale), 0xFFFFFFFF, np.uint32)
        for a in range(0, len(x), 512):
            least = np.minimum(least, ((x[a : a + 512, None] ^ self.shift) * self.scale).min(axis=0))
        key = self.band_number.copy()
        for row in least.reshape(self.bands, self.rows).T:
            key = mix(key + row)
        return key

    @staticmethod
    def odd_sketch(shingles: np.ndarray) -> tuple[bytes, int]:
        """Parity bitmaps of the one-permutation MinHash samples and of all shingles; the number of samples.

        The second is empty for more than SMALL shingles.  Shingles are sorted,
        so the first one in each of the BINS equal ranges of the hash space is
        that bin's minimum.
        """
        bins = shingles >> _U(64 - int(math.log2(BINS)))
        first = np.concatenate([[True], bins[1:] != bins[:-1]]) if len(bins) else np.zeros(0, bool)
        samples = shingles[first]
        odd = []
        for x in (samples, shingles if len(shingles) <= SMALL else shingles[:0]):
            bit = (mix(x) >> _U(64 - int(math.log2(SKETCH_BITS)))).astype(np.int64)
            odd.append((np.bincount(bit, minlength=SKETCH_BITS) & 1).astype(np.uint8))
        return np.packbits(np.concatenate(odd)).tobytes(), len(samples)


def similar(one: np.ndarray, samples_one, size_one, many: np.ndarray, samples_many, size_many) -> np.ndarray:
    """Estimated Jaccard similarity from odd sketches (uint64 lanes), sample counts and set sizes.

    The bitmaps give the number of differing samples, so the number of bins with
    equal minima.  A differing sample meets one of the other set in its bin as
    often as that set fills bins; two that meet are one unequal bin.
    """
    z = np.bitwise_count(one[..., :LANES] ^ many[..., :LANES]).sum(axis=-1, dtype=np.int64)
    differ = -SKETCH_BITS / 2 * np.log1p(-np.minimum(2.0 * z / SKETCH_BITS, 1 - 1e-9))
    equal = np.maximum(samples_one + samples_many - differ, 0) / 2
    meet = -np.expm1(-(size_one + size_many) / (2 * BINS))
    return np.clip(equal / np.maximum(equal + differ * (1 - meet / 2), 1e-9), 0, 1)


def _filled(sizes, similarity) -> np.ndarray:
    """Expected number of bins that the union of two sets fills."""
    return BINS * -np.expm1(-sizes / ((1 + similarity) * BINS))


def slack(sizes, threshold: float) -> np.ndarray:
    """DEVIATIONS standard deviations of the estimate at the threshold, for sets of these sizes together.

    One part comes from the choice of minima among the union's shingles, the
    other from samples that fall on the same bit.
    """
    union = sizes / (1 + threshold)
    filled = _filled(sizes, threshold)
    minima = threshold * (1 - threshold) / filled * np.maximum(1 - filled / union, 0)
    m, n = 2 * (1 - threshold) * filled, SKETCH_BITS
    odd = n / 4 * (1 - (1 - 2 / n) ** (2 * m)) + n * (n - 1) / 4 * ((1 - 4 / n) ** m - (1 - 2 / n) ** (2 * m))
    bits = np.maximum(odd, 0) / np.exp(-4 * m / n) / (2 * filled) ** 2
    return DEVIATIONS * np.sqrt(minima + bits) + 0.5 / filled


def may_link(one, samples_one, size_one, many, samples_many, size_many, threshold: float) -> np.ndarray:
    """Whether the odd sketches leave a pair a chance to reach the threshold.

    In small sets one or two shingles that share a bin move the estimate by more
    than its slack.  Their second bitmaps hold all shingles, so they differ in no
    more bits than the sets differ in shingles: a bound that no link breaks.
    """
    sizes = size_one + size_many
    estimate = similar(one, samples_one, size_one, many, samples_many, size_many) >= threshold - slack(sizes, threshold)
    differ = np.bitwise_count(one[..., LANES:] ^ many[..., LANES:]).sum(axis=-1, dtype=np.int64)
    return np.where(sizes <= SMALL, differ <= sizes * (1 - threshold) / (1 + threshold) + 1e-6, estimate)


def _signatures(docs: DataFrame, size: int, fold_case: bool, signer: Signer) -> DataFrame:
    """(doc_id, n_shingles, set_lo, set_hi, bands, sketch, samples) for each row with an id."""

    def run(batches):
        for batch in batches:
            for first, end, texts in text_passes(batch.column(1)):
                n, lo, hi, bands, sketches, samples = [], [], [], [], [], []
                for x in shingle_sets(texts, size, fold_case):
                    n.append(len(x))
                    with np.errstate(over="ignore"):
                        lo.append(int(signed(mix(x).sum(keepdims=True))[0]) if len(x) else 0)
                        hi.append(int(signed(mix(x ^ _U(0xA5A5A5A5A5A5A5A5)).sum(keepdims=True))[0]) if len(x) else 0)
                    bands.append(signed(signer.band_keys(x)) if len(x) else None)
                    sketch, m = signer.odd_sketch(x)
                    sketches.append(sketch)
                    samples.append(m)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(n, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(samples, pa.int32())],
                    names=["doc_id", "n_shingles", "set_lo", "set_hi", "bands", "sketch", "samples"],
                )

    return docs.mapInArrow(tidy(run), "doc_id bigint, n_shingles bigint, set_lo bigint, set_hi bigint, bands array<bigint>, sketch binary, samples int")


def _sets(docs: DataFrame, size: int, fold_case: bool) -> DataFrame:
    """(doc_id, shingles) with sorted distinct shingles, for (doc_id, text)."""

    def run(batches):
        for batch in batches:
            for a, b, texts in text_passes(batch.column(1)):
                sets = [signed(x) for x in shingle_sets(texts, size, fold_case)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id bigint, shingles array<bigint>")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * |intersection| >= percent * |union|."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").where(both * 100 >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def _lanes(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint64).reshape(len(column), 2 * LANES)


def _agreeing(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose odd sketches agree."""

    def agree(s: pd.Series, m: pd.Series, n: pd.Series, other_s: pd.Series, other_m: pd.Series, other_n: pd.Series) -> pd.Series:
        return pd.Series(may_link(_lanes(s), m.to_numpy(), n.to_numpy(), _lanes(other_s), other_m.to_numpy(), other_n.to_numpy(), threshold))

    agrees = F.pandas_udf(agree, "boolean")
    columns = ["sketch", "samples", "n_shingles"]
    for side in ("a", "b"):
        pairs = pairs.join(sketches.select(F.col("doc_id").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in columns)), side)
    return pairs.where(agrees(*(f"{side}_{c}" for side in ("a", "b") for c in columns))).select("a", "b").distinct()


def _blocks(labelled: DataFrame) -> DataFrame:
    """(bucket, main, p, q) of the buckets with several components.

    ``main`` is the bucket's largest component, which lies in q blocks; its other
    members lie in p blocks.  A bucket of one block's size is one block.
    """
    parts = labelled.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    sizes = parts.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("m"), F.sum("n").alias("n"), F.count("*").alias("parts")).where("parts > 1")
    block = F.least(F.lit(MOST_BLOCK), F.greatest(F.lit(LEAST_BLOCK), F.ceil(8 * F.sqrt("n"))))
    whole = F.col("n") <= LEAST_BLOCK
    p, q = F.ceil((F.col("n") - F.col("m.n")) / block).cast("int"), F.ceil(F.col("m.n") / block).cast("int")
    return sizes.select("bucket", F.when(~whole, F.col("m.component")).alias("main"), F.when(whole, 1).otherwise(p).alias("p"), F.when(whole, 0).otherwise(q).alias("q"))


def _cross_pairs(members: DataFrame, threshold: float) -> DataFrame:
    """Pairs of a bucket in different components whose odd sketches agree.

    ``members(bucket, main, p, q, doc_id, component, sketch, samples, n_shingles, bands)``.
    Blocks outside the bucket's main component meet all its blocks, two blocks in a
    task; blocks of the main component never meet each other.  A pair that shares
    several buckets is given by that of its first shared band alone.
    """
    inside = F.col("component").eqNullSafe(F.col("main"))
    block = F.pmod(F.xxhash64("doc_id"), F.when(inside, F.col("q")).otherwise(F.col("p"))).cast("int") + F.when(inside, F.col("p")).otherwise(0)
    dealt = members.withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("p") - 1 + F.when(inside, 0).otherwise(F.col("q")))))
    key = ["bucket", "i", "j"]
    dealt = dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc_id", "component", "samples", "n_shingles", "sketch", "bands")

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch]).combine_chunks()
            # the last group may go on in the next batch
            group = np.stack([table.column(c).to_numpy() for c in key])
            cut = int(np.flatnonzero((group != group[:, -1:]).any(axis=0)).max(initial=-1)) + 1 if table.num_rows else 0
            rest = table.slice(cut)
            if cut:
                yield _compared(table.slice(0, cut), threshold)
        if rest is not None and rest.num_rows:
            yield _compared(rest, threshold)

    found = dealt.repartition(*key).sortWithinPartitions(*key, "own").mapInArrow(tidy(run), "a bigint, b bigint")
    return found.distinct()


#: Pairs of sketches compared in one numpy pass.
PAIRS = 1 << 13


def _compared(table: pa.Table, threshold: float) -> pa.RecordBatch:
    """The pairs of whole groups, sorted by (bucket, i, j, own), whose components differ and whose sketches agree."""
    bucket, i, j, own, ids, part, m, n = (table.column(c).to_numpy() for c in ("bucket", "i", "j", "own", "doc_id", "component", "samples", "n_shingles"))
    lanes, bands = _lanes(table.column("sketch").to_pylist()), table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
    rows = np.arange(len(ids))
    opens = np.ones(len(ids), bool)
    opens[1:] = (np.diff(bucket) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)
    firsts = np.flatnonzero(opens)
    ends = np.append(firsts[1:], len(ids))[np.cumsum(opens) - 1]
    # of two blocks, rows of block i come first and meet those of block j; in one block, a row meets those behind it
    low = np.add.reduceat((own == i).astype(np.int64), firsts)[np.cumsum(opens) - 1] + firsts[np.cumsum(opens) - 1]
    start = np.where(i == j, rows + 1, low)
    count = np.where((i == j) | (own == i), ends - start, 0)
    upto = np.cumsum(count)
    a, b, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while at < len(ids):
        # at least one row, and as many as make up a pass
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, side="right")))
        some = count[at:stop]
        x = np.repeat(rows[at:stop], some)
        y = np.repeat(start[at:stop] - (np.cumsum(some) - some), some) + np.arange(len(x))
        at = stop
        apart = part[x] != part[y]
        x, y = x[apart], y[apart]
        hit = may_link(lanes[x], m[x], n[x], lanes[y], m[y], n[y], threshold)
        x, y = x[hit], y[hit]
        first = (bands[x] == bands[y]).argmax(axis=1)
        mine = bands[x, first] == bucket[x]
        a.append(np.maximum(ids[x], ids[y])[mine])
        b.append(np.minimum(ids[x], ids[y])[mine])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, fold_case: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``."""
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    threshold = percent / 100
    signer = Signer(bands_for(threshold))
    signed_docs = checkpoint(_signatures(docs, shingle, fold_case, signer))
    known = signed_docs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    zero = F.lit(0).cast("bigint")

    # equal sets: one representative
    equal, table = sorted_runs(known.select(F.col("set_lo").alias("k0"), F.col("set_hi").alias("k1"), F.col("n_shingles").alias("k2"), F.col("doc_id").alias("o0"), zero.alias("o1"), zero.alias("o2"), zero.alias("payload")))
    copies = hold(equal.where("copy").select(F.col("o0").alias("doc_id"), F.col("k0").alias("set_lo"), F.col("k1").alias("set_hi"), F.col("h0").alias("rep")).distinct())
    reps = known.join(copies, ["doc_id", "set_lo", "set_hi"], "left_anti").dropDuplicates(["doc_id", "set_lo", "set_hi"])

    # band buckets with two members or more
    banded = hold(reps.select(F.explode("bands").alias("k0"), zero.alias("k1"), zero.alias("k2"), F.col("doc_id").alias("o0"), zero.alias("o1"), zero.alias("o2"), zero.alias("payload")))
    slots, slot_table = sorted_runs(banded)
    release(banded)
    wanted = hold(slots.select(F.col("o0").alias("doc_id")).distinct())
    # a few ids that are not wanted may pass; nothing joins them. Where an id comes with several texts, each text is compared
    sieve = Sieve(wanted)
    some = sieve.passed(known, "doc_id").join(copies, ["doc_id", "set_lo", "set_hi"], "left_anti").dropDuplicates(["doc_id", "set_lo", "set_hi"])
    files = few_files(docs.sparkSession)
    sketches = checkpoint(some.select("doc_id", "sketch", "samples", "n_shingles", "bands").coalesce(files))
    texts = sieve.passed(docs.where("doc_id IS NOT NULL"), "doc_id").withColumn("print", F.xxhash64("text")).dropDuplicates(["doc_id", "print"])
    sets = checkpoint(_sets(texts, shingle, fold_case).coalesce(files))

    partner = F.explode(F.array_distinct(F.array_compact(F.array("h0", "q0"))))
    pairs = slots.select("o0", partner.alias("other")).where("o0 <> other").select(F.greatest("o0", "other").alias("a"), F.least("o0", "other").alias("b")).distinct()
    links = hold(_confirm(_agreeing(pairs, sketches, threshold), sets, percent))
    part = components(links)

    # buckets that are not yet one component
    labelled = slots.select(F.col("k0").alias("bucket"), F.col("o0").alias("doc_id")).distinct().join(part, F.col("doc_id") == F.col("node"), "left")
    labelled = hold(labelled.select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("component")))
    mixed = hold(_blocks(labelled))
    more = _confirm(_cross_pairs(labelled.join(mixed, "bucket").join(sketches, "doc_id"), threshold), sets, percent)

    found = components(links.unionByName(more).unionByName(copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))))
    release(links, labelled, mixed, sets, sketches, wanted, sieve.pages, slot_table, copies, table)
    sized = signed_docs.select("doc_id", "n_shingles")
    joined = sized.where("doc_id IS NOT NULL").join(found, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    # rows without an id are linked with nothing, and do not meet in one task
    alone = sized.where("doc_id IS NULL").withColumn("component_id", F.lit(None).cast("bigint"))
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that are the first of their component, columns unchanged."""
    gone = near_duplicates(docs, id_col=id_col, **options).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    files = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    gone = checkpoint(gone.coalesce(files))
    sieve, key = Sieve(gone), docs[id_col].cast("bigint")
    # only rows that may go are shuffled
    tested = sieve.passed(docs.where(key.isNotNull()), key).join(gone, key == gone["__gone"], "left_anti")
    return tested.unionByName(sieve.stopped(docs.where(key.isNotNull()), key)).unionByName(docs.where(key.isNull()))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, percent=85)


ORACLE = """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(list_slice(w, i, i + 2)) AS h
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
rare AS (SELECT s.doc_id, s.h, n.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY c.c, s.h) AS r
  FROM s JOIN n USING (doc_id) JOIN (SELECT h, count(*) AS c FROM s GROUP BY h) c USING (h)),
pre AS (SELECT doc_id, h, n FROM rare WHERE r <= n - ceil(n * 0.85) + 1),
pair AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM pre a JOIN pre b ON a.h = b.h AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
both_ AS (SELECT p.a, p.b, count(*) AS c FROM pair p JOIN s x ON x.doc_id = p.a JOIN s y ON y.doc_id = p.b AND y.h = x.h GROUP BY p.a, p.b),
link AS (SELECT a, b FROM both_ JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(x, y) AS (SELECT a, a FROM edge UNION SELECT r.x, e.b FROM reach r JOIN edge e ON e.a = r.y),
comp AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(comp.y, d.doc_id) AS component_id, d.doc_id = coalesce(comp.y, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp ON comp.x = d.doc_id
"""
