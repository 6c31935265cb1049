"""Session defaults, the shared folder, and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "graphlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; a cluster's own settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in defaults.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can read, as the cluster names it.

    Without the setting a local session makes itself a folder of its own, once.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors share")
    spark.conf.set(CHECKPOINT_CONF, tempfile.mkdtemp(prefix="graphlens-"))
    return spark.conf.get(CHECKPOINT_CONF)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh table location under the shared folder."""
    return f"{shared_root(spark)}/graphlens/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to a table of the shared folder and go on from there.

    Loops use this instead of `checkpoint`: a table survives lost executors as
    well, and besides the lineage it also drops what the optimizer has inferred
    about the columns, which otherwise grows with every round. Its size on disk
    is known, so small steps are joined without a shuffle.
    """
    path = scratch_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _storage(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _storage(spark, path)
    return files.exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, none where there is no folder."""
    files, at = _storage(spark, path)
    return [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table or a partition of one, wherever it is stored."""
    files, at = _storage(spark, path)
    files.delete(at, True)


def forget(*steps: DataFrame) -> None:
    """Delete tables that `cut` has written, once nothing reads them any more."""
    for step in steps:
        for path in {f.rsplit("/", 1)[0] for f in step.inputFiles()}:
            if "/graphlens/step-" in path:
                remove(step.sparkSession, path)
