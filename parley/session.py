"""Session settings and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split hot partitions even where that costs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the adaptive-execution settings the operators are written for."""
    for key, value in RUNTIME_DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints: the one the cluster names, a temporary one only on a local master.

    The temporary folder goes when the program ends.  On a cluster results are read from the folder after a query has
    returned, so it is the cluster's to clear (spark.cleaner.referenceTracking.cleanCheckpoints, or by age).
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    existing = spark.conf.get("parley.local.dir", None)
    if existing is None:
        existing = tempfile.mkdtemp(prefix="parley-")
        atexit.register(shutil.rmtree, existing, ignore_errors=True)
        spark.conf.set("parley.local.dir", existing)
    return existing


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, in one job, however often they are read."""
    folder = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint; the result survives the loss of executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()
