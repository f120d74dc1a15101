"""Tables: readers, views, writers and the row generator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The tables of a scale-factor folder.
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

FORMATS = ("parquet", "orc", "json", "csv")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Registers the tables of a folder as temporary views."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """Reads files of one of FORMATS; text formats need a schema, which spares a pass that infers one."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}")
    if kind in ("json", "csv") and schema is None:
        raise ValueError(f"{kind} needs a schema")
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", partition_by=(), **options) -> None:
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}")
    writer = df.write.format(kind).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_bucketed(df: DataFrame, name: str, keys, buckets: int, mode: str = "overwrite") -> None:
    """A table hashed and sorted by its join keys, so that later joins on them need no shuffle."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    df.write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(name)


def series(spark: SparkSession, first: int, last: int, name: str = "g") -> DataFrame:
    """Integers ``first`` to ``last``, both included."""
    return spark.range(first, last + 1).select(F.col("id").alias(name))
