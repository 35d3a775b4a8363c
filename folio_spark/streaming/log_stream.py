"""Log events as a stream: windowed counts, sessions, routed files, and resumable work."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folio_spark.operators.logs import redacted, routed
from folio_spark.session import scratch_path


def read(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """A folder or file of Parquet as a stream with the schema that it has now."""
    schema = spark.read.parquet(path).schema
    folder, name = path.rsplit("/", 1)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", name if "." in name else "*.parquet").parquet(folder if "." in name else path)


def window_counts(events: DataFrame, time: str, by: list[str], width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per window and group; state is dropped once the watermark has passed a window."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), *by, "events")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of a key: events with less than ``gap`` between them."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def distinct_work(items: DataFrame, time: str, key: str = "key", late: str = "1 day") -> DataFrame:
    """Work items of which each key passes once within the watermark."""
    return items.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def drain(stream: DataFrame, name: str, mode: str = "append", write: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Run a stream over all that is there and return its result as a table.

    The checkpoint lies in the shared folder, so a repeated start goes on where the last
    one ended. Append leaves the rows of windows that the watermark hasn't passed for later;
    complete gives out all of them.
    """
    spark = stream.sparkSession
    path = scratch_path(spark, f"stream-{name}")
    sink = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)

    def rows(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    query: StreamingQuery = sink.foreachBatch(write or rows).start()
    query.awaitTermination()
    if write is not None:
        return spark.createDataFrame([], stream.schema)
    out = spark.read.option("basePath", f"{path}/out").schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch int").parquet(f"{path}/out")
    if mode == "complete":
        out = out.where(F.col("batch") == (out.agg(F.max("batch")).first()[0] or 0))
    return out.drop("batch")


def hub(events: DataFrame, folder: str) -> StreamingQuery:
    """Redact and route events to one folder per job, each micro-batch written once however often it is tried."""
    def write(batch: DataFrame, number: int) -> None:
        routed(redacted(batch)).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "base_name").json(folder)

    return events.writeStream.option("checkpointLocation", f"{folder}-checkpoint-{uuid.uuid5(uuid.NAMESPACE_URL, folder).hex}").trigger(availableNow=True).foreachBatch(write).start()
