"""Band joins as bucketed equi-joins."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joinwright.operators.joins import join
from joinwright.plans.spec import fresh

#: Positions this many band widths from zero, and beyond, share the first or the last bucket:
#: the band is there hardly wider than the distance between neighbouring doubles.
FARTHEST = float(1 << 50)
_LONG = (-(1 << 63), (1 << 63) - 1)
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.TimestampType, T.TimestampNTZType)


def position(df: DataFrame, name: str) -> Column:
    """A numeric position: microseconds for times, days for dates, the number itself otherwise."""
    kind, col = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col)
    if isinstance(kind, T.DateType):
        return F.datediff(col, F.lit("1970-01-01").cast("date")).cast("bigint")
    if isinstance(kind, _WHOLE):
        return col.cast("bigint")
    if isinstance(kind, T.NumericType):
        return col
    raise TypeError(f"{name} of type {kind.simpleString()} has no position")


def _whole_bounds(at: Column, low: float, high: float, include_low: bool, include_high: bool) -> tuple[Column, Column]:
    """Both bounds as inclusive bigints; NULL where no bigint lies inside, saturated where one bound lies beyond them all."""
    first = math.ceil(low) if include_low else math.floor(low) + 1
    last = math.floor(high) if include_high else math.ceil(high) - 1
    if not (_LONG[0] <= first <= _LONG[1] and _LONG[0] <= last <= _LONG[1]):
        raise ValueError("the band's bounds are no bigints")
    beyond = [F.lit(_LONG[0]) if first < 0 else F.lit(None).cast("bigint"), F.lit(_LONG[1]) if last > 0 else F.lit(None).cast("bigint")]
    return tuple(F.when(at.isNotNull(), F.coalesce(F.try_add(at, F.lit(b).cast("bigint")), x)) for b, x in zip((first, last), beyond, strict=True))


def _bucket(at: Column, width: float) -> Column:
    """A bucket that never falls as ``at`` rises (NaN being the largest number), whatever is lost to rounding."""
    place = at.cast("double") / F.lit(width)
    return F.floor(F.greatest(F.least(place, F.lit(FARTHEST)), F.lit(-FARTHEST)))


def band_join(left: DataFrame, right: DataFrame, left_column: str, right_column: str, low: float, high: float, include_low: bool = True, include_high: bool = True, on=(), residual: str | None = None, strategy: str = "auto") -> DataFrame:
    """Inner join with ``left + low <= right <= left + high`` (either bound may be strict).

    Bounds are microseconds for times, days for dates.  Buckets are as wide as
    the band (1 at least for whole numbers, dates and times) and rise with the
    position, so the buckets from that of ``left + low`` to that of ``left +
    high`` hold every match: two or three for a left row, one for a right row.
    Buckets are hashed like any key, and the exact predicate follows.  A floating band
    of no width joins by equality.  Rows with a NULL column match nothing;
    infinities and NaN match as the predicate has it, where NaN is equal to NaN and
    above all numbers.
    """
    if high < low:
        raise ValueError("the band is empty: high < low")
    kinds = [df.schema[c].dataType for df, c in ((left, left_column), (right, right_column))]
    taken = {*left.columns, *right.columns}
    bucket, lo, hi, there = (fresh(f"__{n}", taken) for n in ("band", "low", "high", "at"))
    at, whole = position(left, left_column), all(isinstance(k, _WHOLE) for k in kinds)
    if whole:
        bounds = _whole_bounds(at, low, high, include_low, include_high)
        include_low = include_high = True
    else:
        exact = any(isinstance(k, T.DecimalType) for k in kinds)
        bounds = [at + F.lit(Decimal(str(b)) if exact and not isinstance(b, Decimal) else b) for b in (low, high)]
    width = float(high - low)
    r = right.withColumn(there, position(right, right_column)).where(F.col(there).isNotNull())
    l = left.withColumn(lo, bounds[0]).withColumn(hi, bounds[1]).where(F.col(lo).isNotNull() & F.col(hi).isNotNull())
    if not whole and width <= 0:
        l, r = l.withColumn(bucket, F.col(lo)), r.withColumn(bucket, F.col(there))
    else:
        width = max(width, 1.0) if whole else width
        l = l.where(F.col(lo) <= F.col(hi)).withColumn(bucket, F.explode(F.sequence(_bucket(F.col(lo), width), _bucket(F.col(hi), width))))
        r = r.withColumn(bucket, _bucket(F.col(there), width))
    predicate = f"r.{there} {'>=' if include_low else '>'} l.{lo} AND r.{there} {'<=' if include_high else '<'} l.{hi}"
    found = join(l, r, [bucket, *on], residual=predicate if residual is None else f"({predicate}) AND ({residual})", strategy=strategy)
    return found.select(*(F.col(f"l.`{c}`") for c in left.columns), *(F.col(f"r.`{c}`") for c in right.columns))
