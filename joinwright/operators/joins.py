"""Joins with a chosen or advised strategy.

Every function returns the left columns followed by the right ones (left only for
semi and anti joins); the sides have the aliases ``l`` and ``r``.  The full
predicate is always evaluated, NULL keys never match ``=``, NaN equals NaN, and
keys of different widths are compared after widening, as SQL has it.  Keys may be
SQL expressions over the columns of their side.  A broadcast needs a side of
checked size; beyond it the join shuffles.
"""

from __future__ import annotations

import math
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joinwright.config import JoinConfig
from joinwright.plans.advisor import Advice, advise, size_of
from joinwright.plans.spec import Clause, Spec, clauses, compare, fresh

_HINTS = {"broadcast_hash": "broadcast", "shuffle_hash": "shuffle_hash", "merge": "merge", "broadcast_loop": "broadcast", "product": "shuffle_replicate_nl"}
_MIRROR = {"<": ">", "<=": ">=", ">=": "<=", ">": "<"}

#: Pairs of rows, at most by the advisor's estimate, that a nested loop compares one and all.
LOOP_PAIRS = float(1 << 26)
#: Rows of the smaller side in a block of the loop over more pairs; rows of one key share a block, however many.
BLOCK_ROWS = 8
#: Blocks at least: an empty one costs nothing, while blocks too few, for an estimate too low, compare rows of other keys.
BLOCKS = 1 << 31
#: Files hold up to about as many times the rows that the estimate reads from their bytes (6.3 in 60 copies of documents).
SLACK = 8
#: Pairs that a task makes at most, about, where a join is asked to mind its fan-out.
TASK_PAIRS = 4 << 20
_HASHED = (T.NumericType, T.BooleanType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType)


def join(left: DataFrame, right: DataFrame, on=(), how: str = "inner", strategy: str = "auto", residual: str | None = None, config: JoinConfig | None = None, fan_out: bool = False) -> DataFrame:
    """Joins by ``on``: names, (left, right) pairs or (left, op, right) triples with op of = <=> < <= >= > <>.

    ``strategy`` is auto, hash, merge or nestloop; ``residual`` is a predicate
    over ``l.x`` and ``r.y``.  With ``fan_out`` an inner join whose keys repeat on both
    sides counts its pairs first (which reads both sides once more) and is cut into
    tasks by them, as the sizes of its inputs tell nothing of its work.
    """
    if strategy not in ("auto", "hash", "merge", "nestloop"):
        raise ValueError(f"unknown strategy {strategy!r}")
    config = config or JoinConfig.of(left.sparkSession)
    given = clauses(on)
    if how == "right":
        # the right side is preserved, so the left one is the side to build from
        mirrored = tuple(Clause(c.right, _MIRROR.get(c.op, c.op), c.left) for c in given)
        return _planned(right, left, Spec(mirrored, residual, "left"), config, strategy, ("r", "l")).select("l.*", "r.*")
    return _planned(left, right, Spec(given, residual, how), config, strategy, ("l", "r"), fan_out and how == "inner")


def _keys(df: DataFrame, expressions: list[str], taken: set[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with a column for each expression that is no column of it already, and the columns' names."""
    names = [e if e in df.columns else fresh("__key", taken) for e in expressions]
    return df.select("*", *(F.expr(e).alias(n) for e, n in zip(expressions, names, strict=True) if e != n)), names


def _planned(left: DataFrame, right: DataFrame, spec: Spec, config: JoinConfig, strategy: str, names: tuple[str, str], fan_out: bool = False) -> DataFrame:
    blocks = _block_count(left, right, spec, config) if strategy == "nestloop" else 0
    # an expression is resolved on its own side, so its text is never rewritten
    taken = {*left.columns, *right.columns}
    (one, left_keys), (two, right_keys) = (_keys(df, [getattr(c, side) for c in spec.clauses], taken) for df, side in ((left, "left"), (right, "right")))
    added = one.columns != left.columns or two.columns != right.columns
    block = fresh("__block", taken)
    looped = _in_blocks(one, two, left_keys, right_keys, spec, blocks, block) if blocks else None
    if looped:
        # the loop runs inside the blocks, which meet by any equi-join
        advice = advise(left, right, spec, replace(config, enable_nestloop=False))
        one, two = looped
        added = True
    else:
        advice = advise(left, right, spec, config, strategy)
    met = [block] if looped else []
    if fan_out and config.enable and advice.strategy in ("broadcast_hash", "shuffle_hash", "merge") and len(spec.keys) == len(spec.clauses):
        salt = fresh("__salt", taken)
        one, two, salted = _in_tasks(one, two, left_keys, right_keys, spec, advice, met, salt)
        if salted:
            met, added = [*met, salt], True
    one, two = one.alias(names[0]), two.alias(names[1])
    loop = looped is not None or advice.strategy in ("broadcast_loop", "product")
    terms = [compare(c.op, F.col(f"{names[0]}.`{a}`"), F.col(f"{names[1]}.`{b}`"), loop) for c, a, b in zip(spec.clauses, left_keys, right_keys, strict=True)]
    terms += [F.col(f"{names[0]}.`{c}`") == F.col(f"{names[1]}.`{c}`") for c in met]
    if spec.residual:
        terms.append(F.expr(spec.residual))
    if advice.strategy in _HINTS:
        hint = _HINTS[advice.strategy]
        one, two = (one.hint(hint), two) if advice.side == "left" else (one, two.hint(hint))
    if not terms:
        return one.crossJoin(two) if spec.how in ("inner", "cross") else one.join(two, F.lit(True), spec.how)
    found = one.join(two, reduce(lambda a, b: a & b, terms), spec.how)
    if not added:
        return found
    sides = [(names[0], left), (names[1], right)][: 1 if spec.how in ("left_semi", "left_anti") else 2]
    return found.select(*(F.col(f"{n}.`{c}`") for n, df in sides for c in df.columns))


def _block_count(left: DataFrame, right: DataFrame, spec: Spec, config: JoinConfig) -> int:
    """Blocks for a nested loop over keys, 0 where every pair is compared."""
    if not spec.keys or not config.enable or not config.enable_nestloop:
        return 0
    l, r = (s.rows * (1 if s.counted else SLACK) for s in (size_of(left), size_of(right)))
    return 0 if l * r <= LOOP_PAIRS else max(BLOCKS, math.ceil(min(l, r) / BLOCK_ROWS))


def _in_blocks(one: DataFrame, two: DataFrame, left_keys: list[str], right_keys: list[str], spec: Spec, blocks: int, name: str) -> tuple[DataFrame, DataFrame] | None:
    """Both sides with the block of their keys: rows whose keys are equal share one, a row that matches nothing has none.

    None where no key has a type whose hash follows its comparison.
    """
    hashed = []
    for c, a, b in zip(spec.clauses, left_keys, right_keys, strict=True):
        if c.op in ("=", "<=>"):
            kind = _compared_as(one, a, two, b)
            if kind is not None:
                hashed.append((c.op, a, b, kind))
    if not hashed:
        return None

    def blocked(df, at):
        # adding zero makes a negative zero, which equals zero, one
        keys = [F.col(f"`{k[at]}`").cast(k[3]) + (F.lit(0).cast(k[3])) if k[3] in ("float", "double") else F.col(f"`{k[at]}`").cast(k[3]) for k in hashed]
        block = F.pmod(F.xxhash64(*keys), F.lit(blocks))
        known = [F.col(f"`{k[at]}`").isNotNull() for k in hashed if k[0] == "="]
        return df.withColumn(name, F.when(reduce(lambda a, b: a & b, known), block) if known else block)

    return blocked(one, 1), blocked(two, 2)


def _in_tasks(one: DataFrame, two: DataFrame, left_keys: list[str], right_keys: list[str], spec: Spec, advice: Advice, met: list[str], salt: str) -> tuple[DataFrame, DataFrame, bool]:
    """Both sides laid out so that each task makes about ``TASK_PAIRS`` pairs, and whether ``salt`` is a further key.

    Beside a broadcast the other side is dealt evenly.  In a shuffle the larger side's
    rows of a key are split by their hash and the smaller side's repeated for each part.
    """
    counted = [df.groupBy(*(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys))).agg(F.count("*").alias(n)) for df, keys, n in ((one, left_keys, "m"), (two, right_keys, "w"))]
    clauses = [Clause(f"k{i}", c.op, f"k{i}") for i, c in enumerate(spec.clauses)]
    pairs = F.col("m") * F.col("w")
    total, most = join(*counted, clauses).agg(F.sum(pairs), F.max(pairs)).first()
    tasks = math.ceil((total or 0) / TASK_PAIRS)
    if tasks <= 1:
        return one, two, False
    if advice.strategy == "broadcast_hash":
        return (one, two.repartition(tasks), False) if advice.side == "left" else (one.repartition(tasks), two, False)
    parts = math.ceil(most * 4 / TASK_PAIRS)
    rows = [F.xxhash64(*(F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString())) for df in (one, two)]
    dealt = [F.pmod(r, F.lit(parts)).cast("int").alias(salt) for r in rows]
    again = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias(salt)
    large = size_of(one).rows >= size_of(two).rows
    one, two = one.select("*", dealt[0] if large else again), two.select("*", again if large else dealt[1])
    # a number of partitions that is asked for is not cut down again for the bytes being few
    keys = [(met or k) + [salt] for k in (left_keys, right_keys)]
    return one.repartition(tasks, *(F.col(f"`{k}`") for k in keys[0])), two.repartition(tasks, *(F.col(f"`{k}`") for k in keys[1])), True


def _compared_as(one: DataFrame, a: str, two: DataFrame, b: str) -> str | None:
    """The type in which two columns are compared, if equal values of it have equal hashes."""
    condition = one.select(F.col(f"`{a}`").alias("a")).join(two.select(F.col(f"`{b}`").alias("b")), F.col("a") == F.col("b"))._jdf.queryExecution().analyzed().condition().get()
    kind = condition.left().dataType().simpleString()
    same = one.select(F.col(f"`{a}`").cast(kind)).schema[0].dataType
    return kind if isinstance(same, _HASHED) or kind == "string" else None


def hash_join(left: DataFrame, right: DataFrame, on, how: str = "inner", **options) -> DataFrame:
    return join(left, right, on, how, "hash", **options)


def merge_join(left: DataFrame, right: DataFrame, on, how: str = "inner", **options) -> DataFrame:
    return join(left, right, on, how, "merge", **options)


def nested_loop_join(left: DataFrame, right: DataFrame, on=(), how: str = "inner", **options) -> DataFrame:
    return join(left, right, on, how, "nestloop", **options)


def left_where_missing(left: DataFrame, right: DataFrame, on, tested: str, **options) -> DataFrame:
    """Left rows of ``LEFT JOIN ... WHERE right.tested IS NULL``.

    An anti join if the tested column cannot be NULL in a match: it is an ``=`` key
    or not nullable.  Otherwise the outer join and its filter, which also keep
    matches whose tested value is NULL.
    """
    spec = Spec(clauses(on))
    plain = {c.right for c in spec.clauses if c.op != "<=>"}
    if tested in plain or not right.schema[tested].nullable:
        return join(left, right, on, "left_anti", **options)
    return join(left, right, on, "left", **options).where(F.col(f"r.`{tested}`").isNull()).select("l.*")


def not_in(left: DataFrame, right: DataFrame, left_column: str, right_column: str, **options) -> DataFrame:
    """Left rows with ``left_column NOT IN (SELECT right_column FROM right)``, NULL-aware.

    One aggregated row of facts about the right side (any rows, any NULL) is
    attached to the left, so the anti join stays an equi-join of any strategy
    instead of a single-threaded NULL-aware one.
    """
    facts = right.agg(F.count(F.lit(1)).alias("__n"), F.count(F.when(F.col(right_column).isNull(), 1)).alias("__nulls"))
    rest = join(left, right.select(right_column), [(left_column, right_column)], "left_anti", **options)
    known = rest.crossJoin(F.broadcast(facts))  # one row
    return known.where((F.col("__n") == 0) | ((F.col("__nulls") == 0) & F.col(f"l.`{left_column}`").isNotNull())).select("l.*")
