"""Fixtures, strategies, defects that other engines show, plans."""

import math
import random

import pytest
from checks import rows

from joinwright.config import JoinConfig, loaded
from joinwright.functions.columns import int_div, nulls_last
from joinwright.operators.bands import band_join
from joinwright.operators.joins import hash_join, join, left_where_missing, merge_join, nested_loop_join, not_in
from joinwright.plans.advisor import Size, advise, choose, relation_bytes
from joinwright.plans.explain import describe, join_operators, properties
from joinwright.plans.spec import Spec, clauses
from joinwright.plans.steer import advice_of, sql, steer
from joinwright.sources import tables
from pyspark.sql import functions as F

STRATEGIES = ("auto", "hash", "merge", "nestloop")
every = pytest.mark.parametrize("strategy", STRATEGIES)


def frame(spark, kind, values):
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"k {kind}, i int")


def pairs(left, right, strategy, op="=", how="inner"):
    found = join(left, right, [("k", op, "k")], how, strategy)
    return sorted((tuple(r) for r in found.select("l.i", "r.i").collect()), key=repr)


def brute(a, b, test):
    return sorted(((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x is not None and y is not None and test(x, y)), key=repr)


@every
@pytest.mark.parametrize(
    "kind, a, b",
    [
        ("int", [0, -1, 5, None, 2147483647, -2147483648], [0, -1, None, 999, 2147483647, -2147483648, 0]),
        ("bigint", [0, -1, 4294967297, 1, None], [0, -1, 4294967297, 4294967297, None]),
        ("double", [0.0, 1.5, 3.0, None], [-0.0, 1.5, 1.5, None]),
        ("string", ["a", "", None, "b"], ["a", "a", "", None]),
        ("smallint", [1, 2], [2, 2]),
        ("boolean", [True, None], [True, False]),
        ("int", [None, None], [None]),
        ("int", [], [1]),
        ("int", [1] * 5 + [2], [1] * 3 + [3]),
        ("int", [-10, -5, 0, 5, 10], [-10, 0, 10, 20]),
    ],
)
def test_equality(spark, strategy, kind, a, b):
    assert pairs(frame(spark, kind, a), frame(spark, kind, b), strategy) == brute(a, b, lambda x, y: x == y)


@every
def test_nan_equals_nan(spark, strategy):
    nan = float("nan")
    a, b = [nan, 0.0, -0.0, 1.5, None], [nan, 0.0, None]
    assert pairs(frame(spark, "double", a), frame(spark, "double", b), strategy) == brute(a, b, lambda x, y: x == y or (math.isnan(x) and math.isnan(y)))
    assert len(pairs(frame(spark, "double", a), frame(spark, "double", b), "auto", "<>")) == 5
    assert len(pairs(frame(spark, "double", a), frame(spark, "double", b), "auto", "<")) == 3
    assert len(pairs(frame(spark, "double", a), frame(spark, "double", b), strategy, "<=>")) == 4


@every
def test_mixed_widths_are_widened(spark, strategy):
    assert pairs(frame(spark, "int", [1, 2]), frame(spark, "bigint", [1, 4294967297]), strategy) == [(0, 0)]


@every
def test_pair_with_null_never_matches(spark, strategy):
    a = spark.createDataFrame([(1, None, 0), (0, 0, 1), (1, 2, 2)], "a int, b int, i int")
    found = join(a, a, ["a", "b"], strategy=strategy).select("l.i", "r.i")
    assert sorted(map(tuple, found.collect())) == [(1, 1), (2, 2)]


@every
def test_residual_is_applied(spark, strategy):
    a = spark.createDataFrame([(1, 5), (1, 7), (2, 1)], "k int, v int")
    found = join(a, a, "k", strategy=strategy, residual="l.v < r.v")
    assert [(r[1], r[3]) for r in found.collect()] == [(5, 7)]


@every
def test_ninth_key_counts(spark, strategy):
    names = [f"k{i}" for i in range(9)]
    a = spark.createDataFrame([(*([1] * 9),)], names)
    b = spark.createDataFrame([(*([1] * 8), 2)], names)
    assert join(a, b, names, strategy=strategy).count() == 0
    assert join(a, a, names, strategy=strategy).count() == 1


@pytest.mark.parametrize("strategy", ("auto", "hash", "merge"))
def test_groups_larger_than_a_batch(spark, strategy):
    a = tables.series(spark, 1, 2100).select(F.lit(7).alias("k"), "g")
    assert join(a, a, "k", strategy=strategy).count() == 2100 * 2100


@every
def test_reference_counts(spark, strategy):
    def pair(n, key):
        return tables.series(spark, 1, n).select(F.expr(key).alias("k"), F.col("g").alias("v"))

    found = join(pair(1000, "g"), pair(2000, "g % 200 + 1"), "k", strategy=strategy)
    assert tuple(found.agg(F.count("*"), F.sum("l.k")).first()) == (2000, 201000)
    assert join(pair(30, "case when g % 3 = 0 then null else g end"), pair(30, "case when g % 5 = 0 then null else g end"), "k", strategy=strategy).count() == 16
    assert join(pair(300, "(g - 1) div 3 + 1"), pair(202, "(g - 1) div 2 + 50"), "k", strategy=strategy).count() == 306
    assert join(pair(2500, "g"), pair(2000, "g").where("v >= 500"), "k", strategy=strategy).count() == 1501


@pytest.mark.parametrize("strategy", ("auto", "nestloop"))
@pytest.mark.parametrize("op, test", [("<", lambda x, y: x < y), ("<=", lambda x, y: x <= y), (">=", lambda x, y: x >= y), (">", lambda x, y: x > y), ("<>", lambda x, y: x != y)])
@pytest.mark.parametrize("kind", ["int", "bigint", "double", "date"])
def test_inequalities(spark, strategy, op, test, kind):
    import datetime

    value = {"date": lambda n: datetime.date(2020, 1, 1) + datetime.timedelta(n), "double": float}.get(kind, int)
    a, b = [*map(value, (0, 5, 9)), None], [*map(value, (5, 5, 7)), None]
    assert pairs(frame(spark, kind, a), frame(spark, kind, b), strategy, op) == brute(a, b, test)


@every
@pytest.mark.parametrize("how", ["left", "right", "full", "left_semi", "left_anti"])
def test_outer_semi_anti(spark, strategy, how):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "n")], "id int, p string")
    b = spark.createDataFrame([(1, "x"), (4, "z"), (None, "skip")], "id int, q string")
    want = {
        "left": [("a", "x"), ("b", None), ("c", None), ("n", None)],
        "right": [("a", "x"), (None, "z"), (None, "skip")],
        "full": [("a", "x"), ("b", None), ("c", None), ("n", None), (None, "z"), (None, "skip")],
        "left_semi": [("a",)],
        "left_anti": [("b",), ("c",), ("n",)],
    }[how]
    found = join(a, b, "id", how, strategy)
    assert rows(found.select(*["p", "q"][: 1 if how[:5] == "left_" else 2])) == sorted(want, key=repr)


@every
@pytest.mark.parametrize("how", ["left", "full"])
def test_empty_sides(spark, strategy, how):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "id int, p string")
    none = a.where("id < 0")
    assert join(a, none, "id", how, strategy).count() == 2
    assert join(none, a, "id", how, strategy).count() == (2 if how == "full" else 0)


def test_random_keys_agree_across_strategies(spark):
    draw = random.Random(5)
    pool = [None, 0, -1, 1, 2**31 - 1, -(2**31), 4294967297, 2**63 - 1, -(2**63)]
    for _ in range(4):
        a, b = ([draw.choice(pool) for _ in range(draw.randrange(25))] for _ in range(2))
        want = brute(a, b, lambda x, y: x == y)
        for s in STRATEGIES:
            assert pairs(frame(spark, "bigint", a), frame(spark, "bigint", b), s) == want


def test_missing_rewrite_only_where_valid(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(1, None)], "k int, v int")
    by_key = left_where_missing(a, b, "k", "k")
    assert "LeftAnti" in describe(by_key)["types"] and rows(by_key) == [(2,)]
    assert rows(left_where_missing(a, b, "k", "v")) == [(1,), (2,)]


def test_not_in(spark):
    a = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    for values, want in (([], [(1,), (2,), (None,)]), ([1], [(2,)]), ([1, None], []), ([3], [(1,), (2,)])):
        b = spark.createDataFrame([(v,) for v in values], "v int")
        assert rows(not_in(a, b, "k", "v")) == sorted(want, key=repr)


def test_band_join_equals_brute_force(spark):
    draw = random.Random(3)
    a = [draw.choice([None, *range(-50, 50)]) for _ in range(80)]
    b = [draw.choice([None, *range(-50, 50)]) for _ in range(80)]
    left, right = frame(spark, "bigint", a), frame(spark, "bigint", b).withColumnRenamed("k", "m").withColumnRenamed("i", "j")
    for low, high, lo_in, hi_in in ((0, 7, False, True), (-3, 3, True, True), (0, 0, True, True), (2, 5, True, False)):
        found = band_join(left, right, "k", "m", low, high, lo_in, hi_in)
        want = brute(a, b, lambda x, y: (x + low <= y if lo_in else x + low < y) and (y <= x + high if hi_in else y < x + high))
        assert sorted((tuple(r) for r in found.select("i", "j").collect()), key=repr) == want
    assert "BroadcastNestedLoopJoin" not in join_operators(band_join(left, right, "k", "m", 0, 7))
    with pytest.raises(ValueError):
        band_join(left, right, "k", "m", 1, 0)


@pytest.mark.parametrize("kind", ["double", "float", "decimal(12,3)", "int"])
def test_band_join_on_random_numbers(spark, kind):
    import decimal

    import numpy as np

    draw = random.Random(17)
    make = {"double": float, "float": lambda x: float(np.float32(x)), "decimal(12,3)": lambda x: decimal.Decimal(str(x)).quantize(decimal.Decimal("0.001")), "int": lambda x: int(x)}[kind]
    odd = [float("nan"), float("inf"), float("-inf"), 1e300, -0.0, 2.0**60] if kind in ("double", "float") else []
    odd = [x if kind == "double" else float(np.float32(min(x, 1e38)) if x == x else x) for x in odd]
    a = [make(draw.choice([4110.7, draw.randrange(50000) / 10])) for _ in range(150)] + odd
    b = [make(x + 1.1 * draw.randrange(-1, 12) / 10) if kind != "decimal(12,3)" else make(float(x) + 0.11 * draw.randrange(-1, 12)) for x in a if x not in odd and x == x] + odd
    left, right = frame(spark, kind, a), frame(spark, kind, b).withColumnRenamed("k", "m").withColumnRenamed("i", "j")
    bands = [(0, 1, True, False), (-2.5, 2.5, False, True), (0, 0, True, True)] if kind == "int" else [(0, 1.1, True, True), (-0.001, 0.001, False, True), (0.3, 0.3, True, True), (1e-17, 2e-17, True, True)]
    for low, high, lo_in, hi_in in bands:
        kind_of = "BD" if kind[:7] == "decimal" else ""  # sums of decimals are exact
        exact = f"m {'>=' if lo_in else '>'} k + {low!r}{kind_of} AND m {'<=' if hi_in else '<'} k + {high!r}{kind_of}"
        want = sorted(map(tuple, left.crossJoin(right).where(exact).select("i", "j").collect()))
        assert sorted(map(tuple, band_join(left, right, "k", "m", low, high, lo_in, hi_in).select("i", "j").collect())) == want, (low, high)


def test_band_join_at_the_ends_and_with_clashing_names(spark):
    ends = [-(2**63), -(2**63) + 1, 0, 2**63 - 2, 2**63 - 1]
    left = frame(spark, "bigint", ends).withColumn("__band", F.lit(1)).withColumn("__at", F.lit(2))
    right = frame(spark, "bigint", ends).withColumnRenamed("k", "m").withColumnRenamed("i", "j").withColumn("__LOW", F.lit(3))
    for low, high in ((-1, 1), (1, 5), (-5, -1), (0, 0)):
        found = band_join(left, right, "k", "m", low, high)
        assert found.columns == left.columns + right.columns
        want = [(i, j) for i, x in enumerate(ends) for j, y in enumerate(ends) if x + low <= y <= x + high]
        assert sorted(map(tuple, found.select("i", "j").collect())) == want


def test_settings(spark):
    for bad in (64, 99, 10001):
        with pytest.raises(ValueError, match="batch_size"):
            JoinConfig(batch_size=bad)
    for bad in (0.009, 10.01):
        with pytest.raises(ValueError, match="cost_factor"):
            JoinConfig(cost_factor=bad)
    JoinConfig(batch_size=100, cost_factor=10.0)
    before = spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")
    try:
        JoinConfig(enable_mergejoin=False, batch_size=500).apply(spark)
        assert JoinConfig.of(spark) == JoinConfig(enable_mergejoin=False, batch_size=500)
        assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "500"
    finally:
        JoinConfig().apply(spark)
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", before)
    assert loaded()


def test_switches_act_on_plain_sql(spark, sf):
    o, c = tables.table(spark, sf, "orders"), tables.table(spark, sf, "customer")
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.join.preferSortMergeJoin", "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold")
    before = [spark.conf.get(k, None) for k in keys]
    batch = spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")

    def ran():
        found = spark.sql("select * from {o} join {c} on o_custkey=c_custkey", o=o, c=c)
        found.collect()
        return join_operators(found)

    try:
        JoinConfig(enable_hashjoin=False).apply(spark)
        assert ran() == ["SortMergeJoin"]
        JoinConfig(enable_hashjoin=False).apply(spark)
        JoinConfig(enable_mergejoin=False).apply(spark)
        assert ran() == ["BroadcastHashJoin"]
        JoinConfig(enable=False, enable_hashjoin=False).apply(spark)
        assert ran() == ["BroadcastHashJoin"]
    finally:
        JoinConfig().apply(spark)
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", batch)
    assert [spark.conf.get(k, None) for k in keys] == before


def test_sql_is_planned_by_the_advisor(spark, sf):
    t = {n: tables.table(spark, sf, n) for n in ("customer", "orders", "nation", "supplier")}

    def plan(text, **switches):
        found = sql(spark, text, JoinConfig(**switches), **t)
        plain = spark.sql(text, **t)
        assert rows(found) == rows(plain) and found.dtypes == plain.dtypes
        return join_operators(found)

    where = "select c_name, n_name from {customer}, {nation} where c_nationkey=n_nationkey"
    assert plan(where) == ["BroadcastHashJoin"]
    assert plan(where, enable_hashjoin=False) == ["SortMergeJoin"]
    assert plan(where, broadcast_bytes=0) == ["ShuffledHashJoin"]
    assert plan(where, broadcast_bytes=0, hash_task_bytes=0) == ["SortMergeJoin"]
    assert plan("select * from {orders} right join {customer} on o_custkey=c_custkey", enable_hashjoin=False) == ["SortMergeJoin"]
    assert plan("select n_name, s_name from {nation} full join {supplier} on n_nationkey=s_suppkey", enable_mergejoin=False) == ["ShuffledHashJoin"]
    assert plan("select n_name, s_name from {nation} join {supplier} on n_nationkey<s_suppkey", broadcast_bytes=0) == ["CartesianProduct"]
    # a join that carries a hint, and any join while the engine is off, is left alone
    assert plan("select /*+ MERGE(n) */ c_name from {customer} c join {nation} n on c_nationkey=n_nationkey") == ["SortMergeJoin"]
    assert plan(where, enable=False) == plan(where, enable_hashjoin=False, enable_mergejoin=False, enable_nestloop=False)
    flipped = sql(spark, "select * from {customer} right join {orders} on c_custkey=o_custkey", **t)
    assert [(a.strategy, a.side) for a in advice_of(flipped)] == [("broadcast_hash", "left")]
    assert list(advice_of(steer(t["orders"]))) == []


def test_left_join_is_null_is_recognised(spark):
    spark.createDataFrame([(1, "a"), (2, "b"), (None, "n"), (5, "e")], "id int, p string").createOrReplaceTempView("outer_side")
    spark.createDataFrame([(1, None), (4, "z"), (None, "skip"), (5, "v")], "id int, note string").createOrReplaceTempView("inner_side")

    def types(tail, on="o.id = i.id", columns="o.id, o.p"):
        text = f"select {columns} from outer_side o left join inner_side i on {on} where {tail}"
        assert rows(sql(spark, text)) == rows(spark.sql(text))
        return [p["type"] for p in properties(sql(spark, text))]

    try:
        assert types("i.id is null") == ["LeftAnti"]
        assert types("i.id is null and o.id > 1") == ["LeftAnti"]
        assert types("i.id is null", "o.id = i.id and i.note is not null") == ["LeftAnti"]
        # the value may be NULL in a match, a null-safe key too, and the right columns may be asked for
        assert types("i.note is null") == ["LeftOuter"]
        assert types("i.id is null", "o.id <=> i.id") == ["LeftOuter"]
        assert types("i.id is null", columns="o.id, i.note") == ["LeftOuter"]
    finally:
        spark.catalog.dropTempView("outer_side")
        spark.catalog.dropTempView("inner_side")


def test_properties_of_joins(spark, sf):
    l, o = tables.table(spark, sf, "lineitem"), tables.table(spark, sf, "orders")
    found = hash_join(l, o, [("l_orderkey", "o_orderkey")], residual="r.o_totalprice > 1000")
    for _ in range(2):  # before and after the adaptive plan has run
        (p,) = properties(found)
        assert (p["strategy"], p["type"], p["build_side"], p["residual_reads"]) == ("BroadcastHashJoin", "Inner", "right", [])
        assert "l_orderkey" in p["left_keys"][0] and "o_orderkey" in p["right_keys"][0] and p["build_bytes"] > 0
        found.collect()
    (p,) = properties(merge_join(l, o, [("l_orderkey", "o_orderkey")], "left", residual="l.l_quantity > 2 and r.o_totalprice > l.l_extendedprice"))
    assert (p["strategy"], p["type"], p["build_side"], p["build_bytes"]) == ("SortMergeJoin", "LeftOuter", None, None)
    assert p["residual_reads"] == ["left", "right"] and p["batch_size"] > 0 and p["partitions"] == 4
    (p,) = properties(nested_loop_join(l, o, [("l_orderkey", "<", "o_orderkey")], config=JoinConfig(broadcast_bytes=0)))
    assert (p["strategy"], p["left_keys"], p["build_side"], p["residual_reads"]) == ("CartesianProduct", [], None, ["left", "right"])


def test_plans_follow_the_strategy(spark, sf):
    orders, customer = tables.table(spark, sf, "orders"), tables.table(spark, sf, "customer")
    on = [("o_custkey", "c_custkey")]
    assert join_operators(hash_join(orders, customer, on)) == ["BroadcastHashJoin"]
    assert join_operators(merge_join(orders, customer, on)) == ["SortMergeJoin"]
    assert join_operators(nested_loop_join(orders, customer, on)) == ["BroadcastNestedLoopJoin"]
    tight = JoinConfig(broadcast_bytes=1)
    assert join_operators(hash_join(orders, customer, on, config=tight)) == ["ShuffledHashJoin"]
    assert join_operators(nested_loop_join(orders, customer, on, config=tight)) == ["CartesianProduct"]
    off = JoinConfig(enable=False)
    assert join_operators(merge_join(orders, customer, on, config=off)) == join_operators(orders.join(customer, orders.o_custkey == customer.c_custkey))
    none = JoinConfig(enable_hashjoin=False, enable_mergejoin=False, enable_nestloop=False)
    assert join(orders, customer, on, config=none).count() == orders.count()


def test_memory_guard():
    row = Size(1.0, 100.0, 2)
    assert relation_bytes(Size(1000.0, 100_000.0, 2)) == 1000 * relation_bytes(row) > 100_000
    assert relation_bytes(Size(10.0, 0.0, 5)) > relation_bytes(Size(10.0, 0.0, 2))
    big = JoinConfig(broadcast_bytes=0)
    side, other = Size(1e6, 1e8, 3), Size(1e7, 1e9, 3)
    room = relation_bytes(side) / 3
    for budget, want in ((room * 1.01, "shuffle_hash"), (room * 0.99, "merge")):
        # one key may hold a third of the side, however many tasks there are
        assert choose(other, side, True, "left", 5000, JoinConfig(broadcast_bytes=0, hash_task_bytes=int(budget))).strategy == want
    assert choose(other, Size(1e9, 1e12, 3), True, "inner", 5000, big).side in ("left", "right")
    assert choose(side, other, True, "inner", 200, JoinConfig(broadcast_bytes=int(2e8))).side == "left"
    assert choose(side, other, True, "left", 200, JoinConfig(broadcast_bytes=int(2e8))).strategy != "broadcast_hash"


def test_smaller_side_is_built(spark, sf):
    part, lineitem = tables.table(spark, sf, "part"), tables.table(spark, sf, "lineitem")
    on = [("p_partkey", "l_partkey")]
    for found, side in ((join(part, lineitem, on), "BuildLeft"), (join(lineitem, part, [on[0][::-1]]), "BuildRight"), (join(part, lineitem, on, "left"), "BuildRight")):
        assert side in found._jdf.queryExecution().executedPlan().toString()
    exploded = part.select("p_partkey", F.explode(F.sequence(F.lit(1), F.col("p_size"))).alias("x"))
    assert advise(lineitem, exploded, Spec(clauses([("l_partkey", "p_partkey")]), how="left"), JoinConfig()).strategy == "merge"


def test_key_expressions_are_resolved_on_their_side(spark):
    a = spark.createDataFrame([(1, "2024-01-02 03:00:00", "id")], "id int, t string, v string").selectExpr("id", "cast(t as timestamp) date", "v")
    b = spark.createDataFrame([(1, "2024-01-02 05:00:00", "id")], "ID int, t string, v string").selectExpr("ID", "cast(t as timestamp) date", "v")
    for on in ([("cast(date as date)", "cast(date as date)")], [("ID + 0", "id + 0")], [("concat(v, 'date')", "concat(v, 'date')")], [("date_trunc('DAY', date)", "<=", "date")]):
        found = join(a, b, on)
        assert found.columns == ["id", "date", "v", "ID", "date", "v"] and found.count() == 1
        assert join(a, b, on, "left_semi").columns == a.columns


def test_spec_kinds(spark):
    assert Spec(clauses("a")).kind == "equi" and Spec().kind == "cross"
    assert Spec(clauses([("a", "<", "b")])).kind == "theta"
    assert Spec(clauses([("a", "<", "b"), ("c", ">", "d")])).kind == "general"
    for bad in (lambda: Spec(how="sideways"), lambda: clauses([("a", "~", "b")]), lambda: Spec(clauses("a"), how="cross")):
        with pytest.raises(ValueError):
            bad()
    a = frame(spark, "int", [1])
    assert advise(a, a, Spec(clauses("k")), JoinConfig(enable=False)).strategy == "none"


def test_sources_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    for kind in tables.FORMATS:
        tables.write(df, str(tmp_path / kind), kind)
        schema = "k int, v string"
        assert rows(tables.read(spark, str(tmp_path / kind), kind, schema)) == rows(df)
    with pytest.raises(ValueError):
        tables.read(spark, str(tmp_path / "csv"), "csv")
    assert tables.series(spark, 3, 5).count() == 3


def test_columns(spark):
    df = spark.createDataFrame([(7, None), (-7, 1)], "a int, b int")
    assert [r[0] for r in df.select(int_div(F.col("a"), F.lit(2))).collect()] == [3, -3]
    assert [r.b for r in df.orderBy(*nulls_last("b")).collect()] == [1, None]


def test_streams(spark, tmp_path):
    from joinwright.streaming.enrich import band_join_streams, enrich

    src = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:00:30")], "k int, t string").selectExpr("k", "cast(t as timestamp) t")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    other = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")).selectExpr("1 k2", "t t2")
    static = spark.createDataFrame([(1, "one")], "k int, name string")
    for name, df, want in (("e", enrich(stream, static, "k", "left"), 2), ("b", band_join_streams(stream, other, "k", "k2", "t", "t2", "1 MINUTE", "10 minutes"), 1)):
        query = df.writeStream.format("memory").queryName(name).outputMode("append").start()
        query.processAllAvailable()
        query.stop()
        assert spark.table(name).count() == want
    with pytest.raises(ValueError):
        enrich(stream, static, "k", "full")
