"""What to join: keys, inequalities, bands and residual predicates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

HOWS = ("inner", "left", "right", "full", "left_semi", "left_anti", "cross")

_COMPARE = {
    "=": lambda a, b: a == b,
    "<=>": lambda a, b: a.eqNullSafe(b),
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    ">": lambda a, b: a > b,
    "<>": lambda a, b: a != b,
}


@dataclass(frozen=True)
class Clause:
    """``left op right``: SQL expressions over one side each, columns unqualified."""

    left: str
    op: str
    right: str

    def __post_init__(self) -> None:
        if self.op not in _COMPARE:
            raise ValueError(f"unknown comparison {self.op!r}")


@dataclass(frozen=True)
class Spec:
    """Clauses joined by AND, and a residual predicate over columns ``l.x`` and ``r.y``."""

    clauses: tuple[Clause, ...] = ()
    residual: str | None = None
    how: str = "inner"

    def __post_init__(self) -> None:
        if self.how not in HOWS:
            raise ValueError(f"unknown join type {self.how!r}")
        if self.how == "cross" and (self.clauses or self.residual):
            raise ValueError("a cross join has no predicate")

    @property
    def keys(self) -> tuple[Clause, ...]:
        return tuple(c for c in self.clauses if c.op in ("=", "<=>"))

    @property
    def kind(self) -> str:
        """equi, theta (one inequality), general or cross."""
        if self.keys:
            return "equi"
        if not self.clauses and not self.residual:
            return "cross"
        return "theta" if len(self.clauses) == 1 and not self.residual else "general"


def fresh(name: str, taken: set[str]) -> str:
    """A column name that no side has (names are compared without case), added to ``taken``."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    taken.add(name)
    return name


def clauses(on) -> tuple[Clause, ...]:
    """Clauses from names, (left, right) pairs and (left, op, right) triples."""
    out = []
    for item in [on] if isinstance(on, str) else on or ():
        if isinstance(item, Clause):
            out.append(item)
        elif isinstance(item, str):
            out.append(Clause(item, "=", item))
        elif len(item) == 2:
            out.append(Clause(item[0], "=", item[1]))
        else:
            out.append(Clause(*item))
    return tuple(out)


def compare(op: str, a: Column, b: Column, as_range: bool = False) -> Column:
    """``a op b``; with ``as_range`` an equality becomes ``a <= b AND a >= b``, which is no hash key."""
    if as_range and op == "=":
        return (a <= b) & (a >= b)
    if as_range and op == "<=>":
        return F.coalesce((a <= b) & (a >= b), a.isNull() & b.isNull())
    return _COMPARE[op](a, b)
