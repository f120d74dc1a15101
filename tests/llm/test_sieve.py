"""The bitmap of ids, and that near-dedup shuffles no text whose row it can tell is not needed."""

import random

import pytest

from joinwright.llm import near_dedup
from joinwright.llm.sieve import Sieve


@pytest.mark.parametrize("most", [1, 64])
def test_no_wanted_id_is_stopped(spark, most):
    draw = random.Random(1)
    ids = [draw.randrange(-(2**63), 2**63) for _ in range(6000)] + [0, -1, 7]
    others = [draw.randrange(-(2**63), 2**63) for _ in range(6000)]
    df = spark.createDataFrame([(i,) for i in ids + others], "doc_id bigint").selectExpr("doc_id", "1 as `a.b`")
    sieve = Sieve(spark.createDataFrame([(i,) for i in ids], "i bigint"), most)
    passed, stopped = sieve.passed(df, "doc_id"), sieve.stopped(df, "doc_id")
    assert passed.columns == stopped.columns == df.columns
    passed, stopped = sorted(r.doc_id for r in passed.collect()), sorted(r.doc_id for r in stopped.collect())
    assert set(ids) <= set(passed) and sorted(passed + stopped) == sorted(ids + others)
    assert len(passed) < len(ids) + (1800 if most == 1 else 600)


def test_empty_sieve_stops_all(spark):
    sieve, df = Sieve(spark.createDataFrame([], "i bigint")), spark.range(5)
    assert sieve.passed(df, "id").count() == 0 and sieve.stopped(df, "id").count() == 5


def test_texts_are_not_shuffled_for_a_join(spark, make, monkeypatch):
    plans = []

    def seen(df, write=near_dedup.checkpoint):
        out = write(df)
        plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString()))
        return out

    monkeypatch.setattr(near_dedup, "checkpoint", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near_dedup.near_duplicates(make([(i, f"a b c d e f {i}") for i in range(20)])).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    (plan,) = [p for columns, p in plans if "shingles" in columns]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_dropped_rows_equal_kept_flags(make, monkeypatch):
    draw = random.Random(3)
    base = [" ".join(f"w{draw.randrange(10**6)}" for _ in range(40)) for _ in range(15)]
    docs = [(i, base[i % 15] + (" more" if i > 29 else "")) for i in range(45)] + [(None, "x y z"), (None, base[0])]
    df = make(docs)
    kept = sorted(r.doc_id for r in near_dedup.near_duplicates(df).where("kept AND doc_id IS NOT NULL").collect())
    found = [r.doc_id for r in near_dedup.drop_near_duplicates(df).collect()]
    assert found.count(None) == 2 and sorted(i for i in found if i is not None) == kept == list(range(15))
