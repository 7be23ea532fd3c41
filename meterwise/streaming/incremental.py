"""Incremental gathering: what has landed since the last run, exactly once, with the stream's checkpoint as high-water mark."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.components import shuffles_removed
from ..operators.rollups import HOST_COLUMNS, TASK_COUNTERS, host_rollup, merged_host_rollups
from ..sources.exports import live_slices, rejected, stream_exports

#: What tells the slices of shipments apart in partial rollups.
SLICE = ("shipment", "slice_start", "slice_day")


def gather_new(spark: SparkSession, source: str, target: str, checkpoint: str, schema: StructType) -> StreamingQuery:
    """Rolls up the rows of files that are new in source and appends them to target as partial rollups, then stops.

    Each batch writes the folder of its own number anew, so a batch that is repeated after a failure counts once.
    merged_host_rollups of target gives the rollup of all batches.
    """

    def write(batch: DataFrame, number: int) -> None:
        host_rollup(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def gather_exports(spark: SparkSession, path: str, target: str, checkpoint: str, columns: Sequence[str] = HOST_COLUMNS, renamed: Mapping[str, str] | None = None) -> StreamingQuery:
    """Rolls up the job hosts of shipments committed since the last run and appends them to target/rollups, by shipment and slice,
    and what is wrong with unreadable tarballs to target/rejects; then stops. streamed_rollup gives the whole. Tarballs are read
    once: rollups has a row for each unreadable one too, with its file and error.

    The checkpoint holds the last record of each installation's log; a batch that is repeated writes the folders of its own
    number anew.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("file", F.when(F.col("error").isNotNull(), F.col("file")))
        with shuffles_removed(batch.sparkSession):
            host_rollup(rows, *SLICE, "file", "error").write.mode("overwrite").parquet(f"{target}/rollups/batch={number}")
        rejected(batch.sparkSession.read.parquet(f"{target}/rollups/batch={number}")).write.mode("overwrite").parquet(f"{target}/rejects/batch={number}")

    stream = stream_exports(spark, path, "job_host_summary", columns, renamed)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streamed_rollup(spark: SparkSession, path: str, target: str) -> DataFrame:
    """The rollup of what gather_exports has rolled up so far, without the slices that later shipments have replaced since."""
    parts = spark.read.option("mergeSchema", "true").parquet(f"{target}/rollups").drop("batch")
    parts = parts.where("error IS NULL") if "error" in parts.columns else parts
    days = [r[0] for r in parts.select("slice_day").distinct().collect()]
    live = live_slices(spark, path, "job_host_summary", days)
    # the slices come from the driver, and are few beside the rows, which else would all meet by some ten keys
    return merged_host_rollups(parts.join(F.broadcast(live), ["install_uuid", "shipment", "slice_start"], "left_semi"))


def hourly_usage(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Task runs by hour and organization of a stream of job hosts with a column created; rows later than `late` are left
    out, and an hour is final once it is that old."""
    tasks = F.coalesce(reduce(add, (F.col(c) for c in TASK_COUNTERS)), F.lit(0))  # a null counter voids its row, as in the rollup
    rows = stream.select(F.col("created").cast("timestamp").alias("created"), "organization_name", "host_name", tasks.alias("task_runs"))
    hours = rows.withWatermark("created", late).groupBy(F.window("created", "1 hour").alias("hour"), "organization_name")
    return hours.agg(F.sum("task_runs").alias("task_runs"), F.approx_count_distinct("host_name").alias("hosts")).select(F.col("hour.start").alias("hour"), "organization_name", "task_runs", "hosts")
