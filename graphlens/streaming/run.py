"""Run a stream over what is there and store its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from graphlens.session import scratch_path


def read_files(spark: SparkSession, folder: str, name: str, schema: StructType) -> DataFrame:
    """A stream of the Parquet files called `name` in a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(stream: DataFrame, label: str, mode: str = "append", state_store: str | None = None, home: str | None = None) -> DataFrame:
    """Process all input available now into a table under the shared folder, and read it.

    `home` names the folder of an earlier run to go on from; the result holds the rows of all runs.
    """
    spark = stream.sparkSession
    home = home or scratch_path(spark, label)
    out, state = f"{home}/rows", f"{home}/state"
    before = spark.conf.get(STORE, None)
    if state_store:
        spark.conf.set(STORE, state_store)  # a query keeps the session's settings of its start
    try:
        query = (
            stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", state)
            .trigger(availableNow=True).start()
        )
    finally:
        if state_store:
            spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


LATE = "batch bigint, rows bigint, late bigint"


def drain_counted(stream: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """As `drain`, and a table of its batches: rows read, and rows that came behind the watermark and were dropped.

    The counts are those of the stream's own progress, one row per batch that read
    anything, appended to a table when the batch is done, as a listener would.
    """
    spark = stream.sparkSession
    out, state, late = (scratch_path(spark, x) for x in (label, f"{label}-state", f"{label}-late"))
    query = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    done = {p["batchId"]: p for p in query.recentProgress}
    rows = [
        (k, p["numInputRows"], sum(s["numRowsDroppedByWatermark"] for s in p["stateOperators"])) for k, p in sorted(done.items()) if p["numInputRows"]
    ]
    spark.createDataFrame(rows, LATE).write.parquet(late)
    return spark.read.schema(stream.schema).parquet(out), spark.read.schema(LATE).parquet(late)


def drain_batches(stream: DataFrame, label: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Hand every micro-batch of the available input to `handle`."""
    state = scratch_path(stream.sparkSession, f"{label}-state")
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
