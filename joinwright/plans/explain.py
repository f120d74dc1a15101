"""Which join operators a DataFrame plans and runs, and with what."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

JOINS = ("BroadcastHashJoin", "ShuffledHashJoin", "SortMergeJoin", "BroadcastNestedLoopJoin", "CartesianProduct")


def executed_plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def join_operators(df: DataFrame) -> list[str]:
    """Join operators of the physical plan, outermost first."""
    plan = executed_plan(df)
    if "== Final Plan ==" in plan:
        plan = plan.split("== Initial Plan ==")[0]
    return re.findall("|".join(JOINS), plan)


def describe(df: DataFrame) -> dict[str, object]:
    """Join operators, types, exchanges and codegen spans of a plan."""
    plan = executed_plan(df)
    return {
        "joins": join_operators(df),
        "types": re.findall(r"(?:Join|Product)[^\n]*?\b(Inner|LeftOuter|RightOuter|FullOuter|LeftSemi|LeftAnti|Cross)\b", plan),
        "exchanges": len(re.findall(r"(?<!Broadcast)Exchange ", plan)),
        "broadcasts": plan.count("BroadcastExchange"),
        "codegen_stages": len(set(re.findall(r"\*\((\d+)\)", plan))),
    }


def _nodes(plan):
    """Nodes of a physical plan, outermost first, inside query stages and adaptive plans too."""
    kind = plan.getClass().getSimpleName()
    yield plan
    if kind == "AdaptiveSparkPlanExec":
        inner = [plan.executedPlan()]
    elif kind.endswith("QueryStageExec"):
        inner = [plan.plan()]
    elif kind == "ReusedExchangeExec":
        inner = [plan.child()]
    else:
        inner = [plan.children().apply(i) for i in range(plan.children().size())]
    for child in inner:
        yield from _nodes(child)


def _reads(join) -> list[str]:
    """The sides whose columns the residual predicate of ``join`` reads."""
    if join.condition().isEmpty():
        return []
    found = join.condition().get().references()
    sides = (("left", join.left().outputSet()), ("right", join.right().outputSet()))
    return [name for name, columns in sides if any(columns.contains(a) for a in (found.toSeq().apply(i) for i in range(found.size())))]


def properties(df: DataFrame) -> list[dict[str, object]]:
    """For each join of the physical plan, outermost first, what a plan's reader asks of it.

    strategy, type, left_keys and right_keys, residual and the sides it reads,
    build_side (None for sort-merge joins and products), build_bytes (Catalyst's
    estimate of that side, None where there is none), batch_size of the columnar
    readers and partitions of a shuffle.
    """
    conf = df.sparkSession.conf
    out = []
    for node in _nodes(df._jdf.queryExecution().executedPlan()):
        kind = node.getClass().getSimpleName().removesuffix("Exec")
        if kind not in JOINS:
            continue
        product = kind == "CartesianProduct"
        keys = [[] if product else [x.sql() for x in (k.apply(i) for i in range(k.size()))] for k in (node.leftKeys(), node.rightKeys())]
        side = None if kind in ("SortMergeJoin", "CartesianProduct") else "left" if node.buildSide().toString() == "BuildLeft" else "right"
        link = node.logicalLink()
        size = None
        if side and link.isDefined() and link.get().nodeName() == "Join":
            size = int(str((link.get().left() if side == "left" else link.get().right()).stats().sizeInBytes()))
        out.append(
            {
                "strategy": kind,
                "type": "Inner" if product else node.joinType().toString(),
                "left_keys": keys[0],
                "right_keys": keys[1],
                "residual": node.condition().get().sql() if node.condition().isDefined() else None,
                "residual_reads": _reads(node),
                "build_side": side,
                "build_bytes": size,
                "batch_size": int(conf.get("spark.sql.parquet.columnarReaderBatchSize")),
                "partitions": int(conf.get("spark.sql.shuffle.partitions")),
            }
        )
    return out
