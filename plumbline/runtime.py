"""Session-level helpers: the shared scratch folder, staged tables and size-checked broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session does not name one and runs in one process (tests, a laptop) a folder under /tmp/checkpoints is
    set; on a cluster that is an error, for executors do not see each other's disks.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/plumbline/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, so lost executors cost no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(*frames: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in frames:
        path = getattr(df, "_staged_path", None)
        if path:
            spark = df.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def broadcast_checked(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Hint a broadcast only if ``df`` has at most ``max_rows`` rows; otherwise leave the join to the optimizer.

    The check runs ``df`` up to ``max_rows`` + 1 rows, so pass staged or otherwise cheap frames.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def sized(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """As ``broadcast_checked``, but a larger ``df`` is merged: estimated from compressed files and without what ``explode`` adds, it may be broadcast else."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df.hint("merge")


def null_safe(left: DataFrame, right: DataFrame, names: list[str]):
    """Equality of the named columns in which NULL equals NULL."""
    cond = None
    for n in names:
        c = left[n].eqNullSafe(right[n])
        cond = c if cond is None else cond & c
    return cond
