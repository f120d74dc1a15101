"""Runs of equal keys in a table that is sorted across all its partitions.

Rows are dealt by ranges of key and order columns, so a key that holds a third of
all rows is spread over as many partitions as its rows need and is never gathered
in one task.  Each partition is sorted and its neighbours are compared; what a run
leaves open at a partition's edge is settled from one row of facts for each
partition, which is all that the driver sees.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinwright.llm.storage import checkpoint, few_files
from joinwright.llm.worker import tidy

KEYS, ORDER, HEAD = ("k0", "k1", "k2"), ("o0", "o1", "o2"), ("h0", "h1", "h2")
COLUMNS = [*KEYS, *ORDER, "payload"]
_EDGES = pa.schema([("part", pa.int32()), *((c, pa.int64()) for c in ("c0", "c1", "c2", "l0")), ("first_varied", pa.bool_()), ("last_varied", pa.bool_())])


class _Partition:
    """Compares the neighbours of one sorted partition, batch by batch."""

    def __init__(self, part: int):
        self.part = part
        self.before: tuple | None = None
        self.head = [0, 0, 0]
        self.last = self.runs = 0

    def step(self, table: dict[str, np.ndarray], last: bool) -> pa.RecordBatch:
        """Result rows of ``table`` without its last row, whose next neighbour is unknown; with it if it ends the partition."""
        n = len(table["k0"])
        out = n if last else n - 1
        # group[i], equal[i]: row i has the k0, or all keys, of the row before it
        group, equal = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        group[1:n] = table["k0"][1:] == table["k0"][:-1]
        equal[1:n] = group[1:n]
        for c in KEYS[1:]:
            equal[1:n] &= table[c][1:] == table[c][:-1]
        own = tuple(int(table[c][0]) for c in KEYS)
        first = self.before is None
        if not first:
            group[0], equal[0] = self.before[0] == own[0], self.before == own
        fresh = ~equal[:n]
        start = np.maximum.accumulate(np.where(fresh, np.arange(n), -1))
        head = [np.where(start >= 0, table[c][np.maximum(start, 0)], known) for c, known in zip(ORDER, self.head, strict=True)]
        run = self.runs + np.cumsum(fresh)
        varied = (fresh & group[:n]) | (group[1:] & ~equal[1:])
        ends = np.zeros(n, bool)
        ends[n - 1] = last
        keep = group[:n] | group[1:] | ends
        keep[0] |= first
        keep[out:] = False
        if out:
            self.before, self.head, self.runs = tuple(int(table[c][out - 1]) for c in KEYS), [int(h[out - 1]) for h in head], int(run[out - 1])
        ahead = pa.array(np.append(np.int64(self.last), table["o0"][:-1])[keep], mask=fresh[keep])
        self.last = int(table["o0"][out - 1]) if out else self.last
        columns = [table[c][keep] for c in COLUMNS] + [h[keep] for h in head] + [ahead, fresh[keep], varied[keep], run[keep] == 1, ends[keep], np.full(int(keep.sum()), self.part, np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=[*COLUMNS, *HEAD, "q0", "fresh", "varied", "opens", "ends", "part"])


def _compare(batches):
    partition, rest = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        # a task that writes several partitions runs this for each
        partition = partition or _Partition(batch.column(len(COLUMNS))[0].as_py())
        table = {c: batch.column(i).to_numpy() for i, c in enumerate(COLUMNS)}
        if rest is not None:
            table = {c: np.concatenate([rest[c], table[c]]) for c in COLUMNS}
        yield partition.step(table, False)
        rest = {c: table[c][-1:] for c in COLUMNS}
    if rest is not None:
        yield partition.step(rest, True)


def _settled(facts: list) -> list[tuple]:
    """(part, carried head and q0 or None, first row varied, last row varied) from the partitions' first and last rows, in order."""
    out, before = [], None
    for i, (part, first, last) in enumerate(facts):
        key, end = tuple(first)[:3], tuple(last)[:3]
        after = tuple(facts[i + 1][1])[:3] if i + 1 < len(facts) else None
        head = tuple(last)[6:]
        carried = before[1] if before and before[0] == key else None
        if carried and key == end:
            head = carried
        out.append((part, *((*carried, before[2]) if carried else (None,) * 4), before is not None and before[0][0] == key[0] and before[0] != key, after is not None and after[0] == end[0] and after != end))
        before = (end, head, last[3])
    return out


def sorted_runs(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose k0 occurs twice or more, with the first row of their run.

    ``df`` has the bigint columns COLUMNS, none null: keys k0 to k2, an order o0
    to o2 within equal keys, and a payload; it should be a table, as it is read
    twice.  The result has those and h0 to h2, the order columns of the first row
    with equal keys; q0, the o0 of the row before it in its run, null for the first; ``copy``, whether that is another row; ``varied``, which
    marks some row of each run whose k0 has other runs; and ``part``, the partition of
    the sort that holds the row.  A few rows of a single k0 may
    stay.  The second result is the table behind it, to be released.
    """
    schema = ", ".join(f"{c} bigint" for c in (*COLUMNS, *HEAD, "q0")) + ", fresh boolean, varied boolean, opens boolean, ends boolean, part int"
    order = [*KEYS, *ORDER]
    dealt = df.select(*COLUMNS).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    table = checkpoint(dealt.mapInArrow(tidy(_compare), schema).coalesce(few_files(df.sparkSession)))
    facts = table.where("(opens AND fresh) OR ends").groupBy("part").agg(F.min(F.struct(*order)), F.max(F.struct(*order, *HEAD)))
    rows = _settled(sorted(tuple(r) for r in facts.collect()))  # a row for each partition
    # a list of rows would start Python workers of another kind, which stay beside those of mapInArrow
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_EDGES)
    edges = df.sparkSession.createDataFrame(pa.table([pa.array(x, f.type) for x, f in zip(columns, _EDGES, strict=True)], _EDGES))
    carried = F.col("opens") & F.col("c0").isNotNull()
    head = [F.when(carried, F.col(f"c{i}")).otherwise(F.col(h)).alias(h) for i, h in enumerate(HEAD)]
    varied = F.col("varied") | (F.col("opens") & F.col("fresh") & F.col("first_varied")) | (F.col("ends") & F.col("last_varied"))
    ahead = F.when(F.col("opens") & F.col("fresh"), F.col("l0")).otherwise(F.col("q0")).alias("q0")
    found = table.join(F.broadcast(edges), "part").select(*COLUMNS, *head, ahead, varied.alias("varied"), "part")
    copy = F.struct(*ORDER) != F.struct(*(F.col(h).alias(o) for h, o in zip(HEAD, ORDER, strict=True)))
    return found.withColumn("copy", copy), table
