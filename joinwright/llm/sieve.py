"""A bitmap of hashed ids, by which rows that a join drops are dropped before they are shuffled.

No wanted id is lost; an id that is not wanted may pass, so an exact join follows
where that matters.  The bitmap has 16 bits or more for an id and is bounded: beyond
MOST_PAGES pages more ids pass, and the result stays the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joinwright.llm.storage import hold

#: Bits of one page, as bitmap_construct_agg makes them, and pages at most (32 MB together).
PAGE, MOST_PAGES = 32768, 8192
OWN = ["__page", "__at", "__bits", "__in"]


class Sieve:
    """The ids of the only column of ``ids``, a bigint; ``pages`` is to be released."""

    def __init__(self, ids: DataFrame, most_pages: int = MOST_PAGES):
        self.n = 1
        wanted = 16 * ids.count() / PAGE
        while self.n < min(wanted, most_pages):
            self.n *= 2
        bit = self._bit(F.col(ids.columns[0]))
        bits = ids.select((bit / PAGE).cast("int").alias("__page"), (bit % PAGE).alias("__bit"))
        # whole pages are never shuffled
        self.pages = hold(bits.repartition("__page").groupBy("__page").agg(F.bitmap_construct_agg("__bit").alias("__bits")))

    def _bit(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.n * PAGE).cast("bigint"))

    def _tested(self, df: DataFrame, key: Column | str) -> DataFrame:
        bit = self._bit(F.col(key) if isinstance(key, str) else key)
        paged = df.withColumn("__page", (bit / PAGE).cast("int")).withColumn("__at", (bit % PAGE).cast("int"))
        byte = F.conv(F.hex(F.substring("__bits", F.floor(F.col("__at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
        found = paged.join(F.broadcast(self.pages), "__page", "left")
        return found.withColumn("__in", F.coalesce(F.getbit(byte, F.col("__at") % 8) == 1, F.lit(False)))

    def passed(self, df: DataFrame, key: Column | str) -> DataFrame:
        """The rows of ``df`` whose key may be among the ids."""
        return self._tested(df, key).where("__in").drop(*OWN)

    def stopped(self, df: DataFrame, key: Column | str) -> DataFrame:
        """The rows of ``df`` whose key is not among the ids."""
        return self._tested(df, key).where("NOT __in").drop(*OWN)
