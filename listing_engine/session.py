"""Session builder and the few settings the jobs rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # the matching plans are built from thousands of expressions; recording the
    # Python call site of each one doubles the time to build them
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "listing_engine", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution on; ANSI mode stays at Spark's default."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Keep an intermediate result that several branches of a plan read.

    With a checkpoint folder named by the cluster (spark.checkpoint.dir) the
    result is written there and its lineage ends. Without one it is persisted,
    spilling to disk; lost blocks are computed again from the lineage.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the cluster names in spark.checkpoint.dir; only on one machine a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        folder = tempfile.mkdtemp(prefix="spark-scratch-")
    return f"{folder}/{name}-{uuid.uuid4().hex}"
