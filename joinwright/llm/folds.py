"""Held-out rows and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def labelled_sample(labels: DataFrame, label: str, modulus: int, held: int, rows: int) -> DataFrame:
    """(doc_id, y) of at most ``rows`` labelled ids outside the held-out fold, by smallest hash of the id.

    Null ids and labels are left out; an id with several labels has the largest.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).where(remainder("doc_id", modulus) != held)
    one = usable.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def sampled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, text, y) of the sampled ids; the sample's size is bounded, so it is broadcast."""
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
