"""Session helpers: one place that decides configuration and checkpoint folders.

On a cluster the session already exists and ``spark.checkpoint.dir`` names a shared
folder; we only read it. A local folder is created only for a local session that names none (tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on. AQE re-plans joins and coalesces partitions at run time;
# skew-join splits oversized shuffle partitions (one hot game must not own one task).
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Generated methods above 8000 bytecodes are never JIT-compiled by the JVM; deep nested-struct
    # projections (feed parsing) then run slower than Spark's interpreted path. Fall back for those.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "linecast") -> SparkSession:
    """Local session for tests and the bench; cluster jobs should pass their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", os.path.join(tempfile.gettempdir(), "linecast-warehouse"))
    )
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Set the runtime SQL settings we depend on (safe on an existing cluster session)."""
    for k, v in DEFAULT_CONF.items():
        if spark.conf.isModifiable(k):
            spark.conf.set(k, v)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names. Where it is unset, a local session (tests) gets a
    temporary one; on a cluster that would be another folder on each machine, so it is an error."""
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="linecast-ckpt-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
    return current.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


# Shuffle sizing: aim for partitions of this many input bytes; AQE coalesces the small ones at run
# time and splits skewed ones, so the static count only has to be large enough.
TARGET_PARTITION_BYTES = 256 * 1024 * 1024


def estimated_bytes(df) -> int:
    """Optimizer's size estimate of a DataFrame (file sizes for scans, after pruning)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def size_shuffle_partitions(spark: SparkSession, *inputs, target_bytes: int = TARGET_PARTITION_BYTES) -> int:
    """Set ``spark.sql.shuffle.partitions`` from the estimated input size so each shuffle partition
    holds about ``target_bytes`` (never fewer than twice the default parallelism). Returns the value."""
    total = sum(estimated_bytes(df) for df in inputs)
    floor = 2 * spark.sparkContext.defaultParallelism
    n = max(floor, -(-total // target_bytes))
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(min(target_bytes, 256 * 1024 * 1024)))
    return n
