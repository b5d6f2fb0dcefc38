"""Session settings and the one way this package cuts lineage."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    # Fact-to-fact joins rely on run-time splitting of partitions that hold a hot key.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Sessions are merged on the map side before the shuffle, so a hot key travels condensed.
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.files.maxPartitionBytes": "268435456",
    # Checkpoints that nothing refers to any more are removed.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def session(app: str = "assay", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the one the cluster names in spark.checkpoint.dir.

    A temporary folder is taken only where the setting is absent and driver and executors are one process, which is
    the case in tests. On a cluster the folder must be named: files on one machine's disk would be lost to the others.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    made = tempfile.mkdtemp(prefix="assay-checkpoint-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors and truncates the plan."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
