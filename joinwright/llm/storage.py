"""Where operators cut lineage: tables in the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only by a session on one machine that names no folder, as in tests.
OWN_FOLDER = "/tmp/checkpoints/joinwright"


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, else the folder given to ``setCheckpointDir``; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local["):
        return OWN_FOLDER
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def _path(spark: SparkSession, where: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def few_files(spark: SparkSession) -> int:
    """Files for a table of shuffled rows: a quarter of the shuffle partitions, and no fewer than there are cores.

    On a local disk without Hadoop's native library, each file that an executor
    opens makes its JVM fork ``chmod`` twice.
    """
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes ``df`` under the shared folder and reads it back.

    Unlike ``DataFrame.checkpoint`` the last stage runs once.  Every executor can
    read the table, so losing one costs no recomputation of what came before.
    The table goes when the driver ends, or earlier with ``release``.
    """
    spark = df.sparkSession
    where = f"{folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(where)
    path, fs = _path(spark, where)
    fs.deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(where)
    out._joinwright_table = where
    return out


def hold(df: DataFrame) -> DataFrame:
    """Keeps a small side that is aggregated from tables, so that it is computed once and a join reads it directly.

    It has a short lineage of tables, from which lost blocks are computed again;
    unlike ``checkpoint`` it leaves no files.
    """
    return df.persist()


def release(*tables: DataFrame) -> None:
    """Frees what ``checkpoint`` or ``hold`` made and nothing reads any more."""
    for df in tables:
        where = getattr(df, "_joinwright_table", None)
        if where is None:
            df.unpersist()
            continue
        path, fs = _path(df.sparkSession, where)
        fs.delete(path, True)
        fs.cancelDeleteOnExit(path)
