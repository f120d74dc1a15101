"""Pairs of a join counted by group, without making the pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joinwright.config import JoinConfig
from joinwright.operators.bands import position
from joinwright.operators.joins import LOOP_PAIRS, _keys, join
from joinwright.plans.advisor import size_of
from joinwright.plans.spec import Clause, clauses

#: Blocks of near equal numbers of rows that an order is cut into, so that no task counts through all of it.
BLOCKS = 128
_ORDERED = ("<", "<=", ">", ">=")
#: Types that a union and a comparison widen alike.
_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DoubleType)


def join_counts(left: DataFrame, right: DataFrame, on, by, strategy: str = "auto", name: str = "n", config: JoinConfig | None = None) -> DataFrame:
    """``by`` (columns of ``left``) and the number of pairs of the inner join, groups without a pair left out.

    Equalities: both sides are counted by key, the counts are joined by ``strategy``
    and multiplied.  One or two inequalities: pairs are counted in the order of the
    values, in time that grows as the sorted input (times the logarithm of the distinct
    values of one column if there are two).  Where the pairs are few
    (``LOOP_PAIRS``), and for other predicates, the join itself is counted.  A side may
    be read several times.
    """
    config = config or JoinConfig.of(left.sparkSession)
    by, given = [by] if isinstance(by, str) else list(by), clauses(on)
    plain = [c for c in given if c.op in ("=", "<=>")]
    if config.enable and given and len(plain) == len(given) and strategy != "nestloop":
        return _by_key(left, right, plain, by, strategy, name, config)
    counted = counted_by_order(left, right, given, by, name) if config.enable else None
    if counted is not None:
        return counted
    return join(left, right, on, strategy=strategy, config=config).groupBy(*(F.col(f"l.`{b}`") for b in by)).agg(F.count("*").alias(name))


def counted_by_order(left: DataFrame, right: DataFrame, given, by, name: str = "n") -> DataFrame | None:
    """``join_counts`` in the order of the values; None where that does not apply or the pairs are few."""
    plain, ranged = [c for c in given if c.op == "="], [c for c in given if c.op in _ORDERED]
    if len(ranged) not in (1, 2) or len(plain) + len(ranged) < len(given) or size_of(left).rows * size_of(right).rows <= LOOP_PAIRS:
        return None
    l, r = _columns(left, right, given, by)
    return _by_order(l, r, given, by, name) if all(_comparable(l, r, i, c) for i, c in enumerate(given)) else None


def _by_key(left, right, given, by, strategy, name, config):
    taken = {*left.columns, *right.columns}
    (one, a), (two, b) = _keys(left, [c.left for c in given], taken), _keys(right, [c.right for c in given], taken)
    one = one.groupBy(*(F.col(f"`{c}`") for c in dict.fromkeys([*by, *a]))).agg(F.count("*").alias("__m"))
    two = two.groupBy(*(F.col(f"`{c}`") for c in dict.fromkeys(b))).agg(F.count("*").alias("__w"))
    found = join(one, two, [Clause(x, c.op, y) for x, c, y in zip(a, given, b, strict=True)], strategy=strategy, config=config)
    return found.groupBy(*(F.col(f"l.`{c}`") for c in by)).agg(F.sum(F.col("__m") * F.col("__w")).alias(name))


def _columns(left, right, given, by):
    """Sides with the clauses' values in ``__v0``, ``__v1`` and so on; negative zero is made zero, which it equals."""

    def values(df, side):
        for i, c in enumerate(given):
            value = F.expr(getattr(c, side)).alias(f"__v{i}")
            kind = df.select(value).schema[0].dataType
            yield (F.expr(getattr(c, side)) + F.lit(0.0)).alias(f"__v{i}") if isinstance(kind, T.DoubleType) else value

    return left.select(*(F.col(f"`{b}`") for b in by), *values(left, "left")), right.select(*values(right, "right"))


def _comparable(l, r, i, clause):
    a, b = l.schema[f"__v{i}"].dataType, r.schema[f"__v{i}"].dataType
    if clause.op == "=":
        return a == b
    try:
        position(l, f"__v{i}")
    except TypeError:
        return False
    return clause.op in _ORDERED and (a == b or isinstance(a, _NUMBERS) and isinstance(b, _NUMBERS))


def _by_order(l, r, given, by, name):
    names = [f"__v{i}" for i in range(len(given))]
    keys = [n for n, c in zip(names, given, strict=True) if c.op == "="]
    orders = [(n, c.op) for n, c in zip(names, given, strict=True) if c.op != "="]
    # a NULL matches nothing, a NaN may
    known = reduce(lambda a, b: a & b, (F.col(n).isNotNull() for n in names))
    l = l.where(known).groupBy(*(F.col(f"`{b}`") for b in by), *names).agg(F.count("*").alias("__m"))
    r = r.where(known).groupBy(*names).agg(F.count("*").alias("__w"))
    points = l.select(*names).distinct()
    if len(orders) == 2:
        few = r.agg(*(F.approx_count_distinct(n) for n, _ in orders)).first()
        if few[0] < few[1]:
            orders.reverse()
        (value, op), (coarse, way) = orders
        counted = _by_two(points, r, keys, value, op, coarse, way, names)
    else:
        ((value, op),) = orders
        counted = _counted(*_blocked(points, r, value), keys, value, op)
    counted = counted.select(*(F.col(n).alias(f"{n}p") for n in names), "__n")
    found = l.join(counted, [F.col(n) == F.col(f"{n}p") for n in names]).where("__n > 0")
    return found.groupBy(*(F.col(f"`{b}`") for b in by)).agg(F.sum(F.col("__m") * F.col("__n")).alias(name))


def _blocked(points: DataFrame, weights: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """Both with ``__block``, which never falls as the value rises."""

    def place(df) -> Column:
        return position(df, value).cast("double")

    cuts = weights.agg(F.percentile_approx(place(weights), [i / BLOCKS for i in range(1, BLOCKS)], 1000).alias("__cuts"))

    def cut(df):
        block = F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col("__at"))), F.lit(0))
        return df.withColumn("__at", place(df)).crossJoin(F.broadcast(cuts)).withColumn("__block", block).drop("__at", "__cuts")

    return cut(points), cut(weights)


def _counted(points: DataFrame, weights: DataFrame, within: list[str], value: str, op: str) -> DataFrame:
    """``points`` with ``__n``, the sum of ``__w`` over the rows of ``weights`` that agree in ``within`` and for which ``point op row`` holds.

    Sums run inside a block; a row for each block adds what lies in those before it.
    """
    # a point comes before equal rows or after them: rows below it are counted, or those not above it
    turn = 0 if op in (">", "<=") else 2
    tag = [F.lit(None).cast("bigint").alias("__w"), F.lit(turn).alias("__turn")]
    shared = [*within, "__block", value]
    rest = [c for c in points.columns if c not in shared]
    events = points.select(*shared, *rest, *tag).unionByName(weights.select(*shared, "__w", F.lit(1).alias("__turn")), allowMissingColumns=True)
    run = Window.partitionBy(*within, "__block").orderBy(value, "__turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = events.withColumn("__inside", F.coalesce(F.sum("__w").over(run), F.lit(0))).where("__turn <> 1").drop("__w", "__turn")
    held = events.groupBy(*within, "__block").agg(F.coalesce(F.sum("__w"), F.lit(0)).alias("__held"))
    whole = Window.partitionBy(*within)
    before = F.coalesce(F.sum("__held").over(whole.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.select(*within, "__block", before.alias("__before"), F.sum("__held").over(whole).alias("__total"))
    upto = F.col("__before") + F.col("__inside")
    count = upto if op in (">", ">=") else F.col("__total") - upto
    return inside.join(held, [*within, "__block"]).select(*points.columns, count.alias("__n")).drop("__block")


def _by_two(points, weights, keys, value, op, coarse, way, names):
    """``_counted`` under a second inequality.

    The distinct values of ``coarse`` are ranked so that a point matches the first k of
    them.  Ranks 0 to k - 1 are the disjoint union of one dyadic span for each bit set
    in k, and a row lies in one span of each size: an equality and one inequality remain.
    """
    ranked = weights.select(coarse).distinct().withColumn("__w", F.lit(1).cast("bigint"))
    bits = ranked.agg(F.length(F.bin(F.count("*"))).alias("__bits"))

    def ranks(df, test):
        spots = df.select(coarse).distinct()
        found = _counted(*_blocked(spots, ranked, coarse), [], coarse, test).select(F.col(coarse).alias("__c"), F.col("__n").alias("__rank"))
        return df.join(found, F.col(coarse) == F.col("__c")).drop("__c").crossJoin(F.broadcast(bits))

    def spans(df, odd):
        size = F.expr(f"explode(filter(sequence(0, __bits - 1), j -> shiftright(__rank, j) % 2 = {odd}))").alias("__size")
        return df.select("*", size).withColumn("__span", F.expr(f"shiftright(__rank, __size) - {odd}")).drop("__rank", "__bits")

    points, weights = _blocked(points, weights, value)
    within = [*keys, "__size", "__span"]
    p = spans(ranks(points, way), 1)
    w = spans(ranks(weights, way[0]), 0).groupBy(*within, "__block", value).agg(F.sum("__w").alias("__w"))
    return _counted(p, w, within, value, op).groupBy(*names).agg(F.sum("__n").alias("__n"))
