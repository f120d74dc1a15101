import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang); extra columns may clash with results."""

    def build(rows, **extra):
        from pyspark.sql import functions as F

        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCS).repartition(2)
        for name, value in extra.items():
            df = df.withColumn(name, F.lit(value))
        return df

    return build


#: Column names that results use too.
CLASHING = {"kept": True, "score": 1.0, "n_words": 3, "spans": "x", "component_id": 5, "shard": "y", "quality_rules": "z", "print": 1, "key": "k", "y": 0, "id": 9}


@pytest.fixture
def clashing():
    return dict(CLASHING)


@pytest.fixture
def corpus(sf):
    """(doc_id, text) of the smallest tables."""
    import duckdb

    return duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet' order by doc_id").fetchall()
