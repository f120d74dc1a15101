"""Session settings of the join engine."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

PREFIX = "joinwright."

# Settings, defaults and ranges that users of such an engine know.
BATCH_SIZE_RANGE = (100, 10000)
COST_FACTOR_RANGE = (0.01, 10.0)

#: Settings by which Catalyst chooses between hash and sort-merge joins for a plain ``spark.sql``.
_BROADCAST = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
_PREFER_MERGE = "spark.sql.join.preferSortMergeJoin"
_ADAPTIVE_HASH = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
_CATALYST = (*_BROADCAST, _PREFER_MERGE, _ADAPTIVE_HASH)


@dataclass(frozen=True)
class JoinConfig:
    """Switches and weights of the strategy choice.

    A disabled strategy is never an error: the engine then gives no hint and
    Catalyst plans the join.
    """

    enable: bool = True
    enable_hashjoin: bool = True
    enable_nestloop: bool = True
    enable_mergejoin: bool = True
    batch_size: int = 2000
    cost_factor: float = 0.5
    #: Largest estimated size of a broadcast side, and of a hash table in one task.
    broadcast_bytes: int = 32 << 20
    hash_task_bytes: int = 256 << 20

    def __post_init__(self) -> None:
        for name, (low, high) in (("batch_size", BATCH_SIZE_RANGE), ("cost_factor", COST_FACTOR_RANGE)):
            value = getattr(self, name)
            if isinstance(value, bool) or not low <= value <= high:
                raise ValueError(f"{name} = {value} is outside the valid range ({low} .. {high})")

    @classmethod
    def of(cls, spark: SparkSession) -> JoinConfig:
        """Settings named ``joinwright.<name>`` of the session, defaults elsewhere."""
        found = {}
        for f in fields(cls):
            text = spark.conf.get(PREFIX + f.name, None)
            if text is None:
                continue
            kind = type(f.default)
            if kind is bool:
                if text.lower() not in ("true", "false", "on", "off"):
                    raise ValueError(f"{f.name} = {text} is not a boolean")
                found[f.name] = text.lower() in ("true", "on")
            else:
                found[f.name] = kind(text)
        return cls(**found)

    def _catalyst(self) -> dict[str, str]:
        """What the switches ask of Catalyst; nothing while the engine is off or all strategies are on."""
        if not self.enable or self.enable_hashjoin and self.enable_mergejoin:
            return {}
        if not self.enable_hashjoin:
            return {**dict.fromkeys(_BROADCAST, "-1"), _PREFER_MERGE: "true", _ADAPTIVE_HASH: "0"}
        return {_PREFER_MERGE: "false", _ADAPTIVE_HASH: str(self.hash_task_bytes)}

    def apply(self, spark: SparkSession) -> None:
        """Writes the settings to the session and sizes its columnar batches.

        ``enable_hashjoin`` and ``enable_mergejoin`` act on every ``spark.sql`` of the
        session too: Catalyst's own settings are changed, and given back once the
        switch is on again.  For ``enable_nestloop`` Catalyst has no setting, as it
        runs a loop only where no other join can.
        """
        for f in fields(self):
            value = getattr(self, f.name)
            spark.conf.set(PREFIX + f.name, str(value).lower() if isinstance(value, bool) else str(value))
        for key in ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.inMemoryColumnarStorage.batchSize"):
            spark.conf.set(key, str(self.batch_size))
        wanted = self._catalyst()
        for key in _CATALYST:
            kept = f"{PREFIX}before.{key}"
            before = spark.conf.get(kept, None)
            if before is not None:
                spark.conf.unset(kept)
                spark.conf.set(key, before) if before else spark.conf.unset(key)
            if key in wanted:
                spark.conf.set(kept, spark.conf.get(key, None) or "")
                spark.conf.set(key, wanted[key])


def loaded() -> bool:
    """True once the engine is importable."""
    return True
