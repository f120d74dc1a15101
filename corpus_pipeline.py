"""Corpus cleaning pipeline: STAGES over ``documents``, each written and read again.

1. Quality rules: documents that the rules reject go.
2. MinHash near-dedup: of each group (five-word shingles, similarity 0.8 or
   more) the document with the smallest id stays.
3. Suffix-array dedup: passages of 50 words or more that an earlier document
   holds are cut from the text; ``n_chars`` follows the text.
4. Benchmark decontamination: documents that hold a benchmark item go.
5. SentencePiece encoding: pieces and scores of the N best segmentations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinwright.llm import decontamination, near_dedup, piece_lattice, quality_rules, suffix_dedup
from joinwright.llm.storage import checkpoint, release


def _quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(docs, into="__quality").where(F.col("__quality.kept")).drop("__quality")


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs, shingle=5, percent=80)


def _suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(docs).withColumn("n_chars", F.char_length("text").cast("bigint"))


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_lattice.encode(docs)


STAGES = [
    ("quality rules", _quality_rules),
    ("MinHash near-dedup", _near_dedup),
    ("suffix-array dedup", _suffix_dedup),
    ("benchmark decontamination", _decontamination),
    ("SentencePiece encoding", _encoding),
]

#: Template binding and lattice scores have no plain SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies every stage to ``documents``; each stage's rows are written as Parquet and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = checkpoint(docs)
            if before is not None:
                release(before)
            before = docs
    return docs
