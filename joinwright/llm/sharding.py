"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

Shards are leaves of a tree of regions and racks.  A document descends level by
level: at each node it draws an exponential arrival time for every child, from a
hash of its id and the child's name, with the total weight of the child's subtree
as rate, and goes to the child that arrives first.  So each subtree takes rows in
proportion to its weight, and a changed weight changes only the draws of the
nodes above it: rows move into or out of that subtree at each level, or between
the children of a node on its path, and nowhere else.

One more shard joins in a region of its own, so that no other subtree's weight
changes: rows move to it or stay (law ``key``).

Slots number a shard's rows from 0 without gaps.  They are counted in 4096 hash
buckets a shard, dealt by id and text: bucket sizes give each bucket's first
slot, and rows are numbered inside their bucket, so no task numbers a whole shard
and rows that share an id are spread too.  Rows are placed once, in a table of
their ids, sizes and places.  The table of first slots has at most shards x 4096
rows, whatever the input, and is broadcast while that is at most ``FIRSTS``.

Edge cases: a null text has 16 bytes of size and crc32 0, as an empty one; rows
with a null id share one shard; repeated rows share a shard and have slots of
their own; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from joinwright.llm.storage import checkpoint

SHARDS = 40
RACK = 4
RACKS_PER_REGION = 5
OVERHEAD = 16
#: Rows of first slots that are broadcast without asking.
FIRSTS = 1 << 19
BUCKET_DIGITS = 3


def _draw(key: Column, node: str, child: int, weight: float) -> Column:
    """Arrival time of a child of ``node``: a digest of id, node and the child's group of four holds the draws of four."""
    digest = F.md5(F.concat(key, F.lit(f":{node}/{child // 4}")))
    draw = F.conv(F.substring(digest, 8 * (child % 4) + 1, 8), 16, 10).cast("bigint")
    return -F.ln((draw + F.lit(0.5)) / F.lit(float(1 << 32))) / F.lit(float(weight))


def _first(key: Column, node: str, weights: dict[int, float]) -> Column:
    """(arrival, child) of the child that arrives first; of equal times the smaller child."""
    arrivals = [F.struct(_draw(key, node, c, w).alias("arrival"), F.lit(c).alias("child")) for c, w in weights.items()]
    return F.least(*arrivals) if len(arrivals) > 1 else arrivals[0]


def _by(at: Column, choices: dict[int, Column]) -> Column:
    """The choice whose key ``at`` has; only that one is computed for a row."""
    out = None
    for key, choice in choices.items():
        out = F.when(at == key, choice) if out is None else out.when(at == key, choice)
    return out


def tree(weights: Sequence[float]) -> dict[int, dict[int, dict[int, float]]]:
    """Regions, their racks, their shards and the shards' weights; weight 0 takes nothing."""
    regions: dict[int, dict[int, dict[int, float]]] = {}
    for shard, weight in enumerate(weights):
        if weight < 0:
            raise ValueError("a weight is negative")
        if weight:
            rack = shard // RACK
            regions.setdefault(rack // RACKS_PER_REGION, {}).setdefault(rack, {})[shard] = weight
    if not regions:
        raise ValueError("no shard has a weight")
    return regions


def descend(df: DataFrame, weights: Sequence[float], new_weight: float | None = None) -> DataFrame:
    """``df`` with the columns region, rack and shard for its column ``key``, and grown_shard if one more shard joins."""
    regions, key = tree(weights), F.col("key")
    totals = {r: sum(sum(shards.values()) for shards in racks.values()) for r, racks in regions.items()}
    found = df.select("*", _first(key, "", totals).alias("__region"))
    racks = {r: _first(key, f"r{r}", {k: sum(shards.values()) for k, shards in of.items()})["child"] for r, of in regions.items()}
    found = found.withColumn("region", F.col("__region.child")).withColumn("rack", _by(F.col("region"), racks))
    shards = {k: _first(key, f"k{k}", of)["child"] for racks in regions.values() for k, of in racks.items()}
    found = found.withColumn("shard", _by(F.col("rack"), shards))
    if new_weight is not None:
        # the new shard's region is a new child of the root
        arrival = _draw(key, "", max(len(weights) // (RACK * RACKS_PER_REGION), max(regions) + 1), new_weight)
        found = found.withColumn("grown_shard", F.when(arrival < F.col("__region.arrival"), len(weights)).otherwise(F.col("shard")))
    return found.drop("__region")


def assign(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, id_col: str = "doc_id", text_col: str = "text", new_weight: float = 1.0) -> DataFrame:
    """(doc_id, size, text_crc32, law, region, rack, shard, slot, grown_shard) for each row.

    ``grown_shard`` is the shard once one more, of ``new_weight``, joins the tree.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"),
    )
    bucket = F.conv(F.substring(F.md5(F.concat("key", F.lit(":"), F.col("text_crc32").cast("string"))), 1, BUCKET_DIGITS), 16, 10).cast("int").alias("bucket")
    placed = checkpoint(descend(rows, weights, new_weight).select("doc_id", "size", "text_crc32", "region", "rack", "shard", "grown_shard", bucket))

    sizes = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    firsts = sizes.select("shard", "bucket", before.alias("base"))
    inside = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")) - 1
    numbered = placed.withColumn("inside", inside).join(F.broadcast(firsts) if len(weights) * 16**BUCKET_DIGITS <= FIRSTS else firsts, ["shard", "bucket"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "region", "rack", "shard", (F.col("base") + F.col("inside")).cast("bigint").alias("slot"), "grown_shard")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _sql_draw(node: str, child: str, weight: str) -> str:
    digest = f"md5(key || ':' || {node} || '/' || CAST({child} // 4 AS VARCHAR))"
    return f"-ln((CAST('0x' || substr({digest}, 8 * ({child} % 4) + 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE) / ({weight})::DOUBLE"


_RACKS = SHARDS // RACK
_REGIONS = _RACKS // RACKS_PER_REGION

ORACLE = f"""
WITH crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(0, 8) AS BIGINT[])), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
    FROM range(0, 256) r(i))),
d AS (
  SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) + {OVERHEAD} AS size, coalesce(CAST(doc_id AS VARCHAR), '') AS key FROM documents),
sums AS (
  SELECT d.*, xor(list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, size - {OVERHEAD}), lambda i: CAST('0x' || substr(hex(encode(text)), 2 * i + 1, 2) AS BIGINT))),
    lambda a, x: xor(a >> 8, crc.t[(xor(a, x) & 255) + 1])), 4294967295) AS crc
  FROM d, crc),
keys AS (SELECT DISTINCT key FROM d),
region AS (
  SELECT key, arg_min(r, e) FILTER (WHERE r < {_REGIONS}) AS region, arg_min(r, e) = {_REGIONS} AS moves
  FROM (SELECT key, r, {_sql_draw("''", "r", f"CASE WHEN r < {_REGIONS} THEN {RACK * RACKS_PER_REGION} ELSE 1 END")} AS e FROM keys, range(0, {_REGIONS + 1}) t(r))
  GROUP BY key),
rack AS (
  SELECT key, any_value(moves) AS moves, arg_min(k, e) AS rack
  FROM (SELECT key, moves, k, {_sql_draw("'r' || CAST(region AS VARCHAR)", "k", str(RACK))} AS e FROM region, range(0, {_RACKS}) t(k) WHERE k // {RACKS_PER_REGION} = region)
  GROUP BY key),
shard AS (
  SELECT key, any_value(moves) AS moves, arg_min(s, e) AS shard
  FROM (SELECT key, moves, s, {_sql_draw("'k' || CAST(rack AS VARCHAR)", "s", "1")} AS e FROM rack, range(0, {SHARDS}) t(s) WHERE s // {RACK} = rack)
  GROUP BY key)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY CAST('0x' || substr(md5(key || ':' || CAST(crc AS VARCHAR)), 1, {BUCKET_DIGITS}) AS INTEGER), doc_id, size, crc) - 1 AS slot,
  CAST(CASE WHEN moves THEN {SHARDS} ELSE shard END AS INTEGER) AS grown_shard
FROM sums JOIN shard USING (key)
"""
