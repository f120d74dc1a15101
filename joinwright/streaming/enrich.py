"""The engine's joins over a stream: a static side per micro-batch, or two streams within a band."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def enrich(stream: DataFrame, static: DataFrame, on, how: str = "inner") -> DataFrame:
    """Stream-static equi-join; inner and left are stateless."""
    if how not in ("inner", "left"):
        raise ValueError("a stream joins a static side by inner or left")
    return stream.join(static, on, how)


def band_join_streams(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_time: str, right_time: str, high: str, delay: str) -> DataFrame:
    """Pairs with equal keys and ``left_time < right_time <= left_time + high``.

    Both sides carry a watermark of ``delay``, so their state is dropped once no
    partner can arrive.
    """
    l = left.withWatermark(left_time, delay).alias("l")
    r = right.withWatermark(right_time, delay).alias("r")
    return l.join(r, F.expr(f"l.{left_key} = r.{right_key} AND r.{right_time} > l.{left_time} AND r.{right_time} <= l.{left_time} + INTERVAL {high}"))
