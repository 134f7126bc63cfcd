"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own session."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("tidemark")
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as the cluster names it in `spark.checkpoint.dir`.

    Only a local session may fall back to a temporary folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    in_use = spark.sparkContext.getCheckpointDir()
    if in_use:
        return in_use
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="tidemark-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path under the shared folder, which goes when the application ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/tidemark-{label}-{uuid.uuid4().hex}"
    made = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = made.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(made)
    fs.deleteOnExit(made)
    return f"{folder}/data"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared scratch folder and read it back, column by column as needed.

    Later uses see the same rows, whatever happens to executors. The files go when the
    application ends.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pinned(df: DataFrame) -> DataFrame:
    """Fix `df` in reliable storage, so that every later use sees the same rows."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's own size estimate, which is what decides an automatic broadcast."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def unsized(df: DataFrame) -> bool:
    """Whether the optimizer has no estimate, as for rows made in Python."""
    return plan_bytes(df) >= 1 << 60


def sized_bytes(df: DataFrame) -> int:
    """`plan_bytes`, or where the optimizer has no estimate one from the counted rows."""
    return df.count() * 16 * max(1, len(df.columns)) if unsized(df) else plan_bytes(df)


def broadcast_limit(spark: SparkSession) -> int:
    """The session's automatic broadcast limit in bytes; 0 when broadcasting is off."""
    text = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    units = {"b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}
    text = text.strip().lower()
    number = text.rstrip("bkmg")
    return max(0, int(number) * units.get(text[len(number) :] or "b", 1))
