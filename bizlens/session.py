"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 16 * 1024 * 1024


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("bizlens")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names; a local one only where none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            named = tempfile.mkdtemp(prefix="bizlens-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def pinned(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder, so later steps see one fixed version of the rows
    and a lost executor only re-reads files."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a join side only after counting it; past the limit Spark joins by shuffle."""
    fixed = pinned(df)
    return F.broadcast(fixed) if fixed.count() <= limit else fixed


def light_side(df: DataFrame, base: DataFrame) -> DataFrame:
    """Broadcast ``df``, which has at most the rows of the stored table ``base``, if the files of
    ``base`` are small; past that Spark joins by shuffle. Without the check Spark takes a join of
    two small tables for a large one and may build its hash table from the fact table instead."""
    planned = base._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(planned)) <= BROADCAST_BYTES else df
