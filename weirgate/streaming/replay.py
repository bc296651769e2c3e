"""Stored rows through streams: files in the order of arrival, a run to their end, the table that comes out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import hadoop_path, shared_folder, stored
from .pipeline import into_table, read_table


#: Rows of a file, about: a batch of many rows is several files, which tasks read side by side.
FILE_ROWS = 250_000


def arrival_files(rows: DataFrame, order: str, files: int = 4) -> str:
    """Writes the rows, worked out once, into batches that follow one another in order, by name and by time of modification, which is what Spark's
    file source goes by. There are `files` batches, of one file each or, of many rows, of several with the same time."""
    rows = stored(rows, "to-arrive")
    each = max(1, -(-rows.count() // (files * FILE_ROWS)))
    path = f"{shared_folder(rows.sparkSession, 'arrivals')}/rows"
    rows.repartitionByRange(files * each, order).sortWithinPartitions(order).write.parquet(path)
    store, parts = hadoop_path(rows.sparkSession, f"{path}/part-*")
    for n, x in enumerate(sorted(x.getPath().toString() for x in store.globStatus(parts))):
        store.setTimes(hadoop_path(rows.sparkSession, x)[1], 1_700_000_000_000 + 1000 * (n // each), -1)
    return path


def source(spark: SparkSession, path: str, schema, files_a_batch: int | None = None) -> DataFrame:
    """A stream of the files at path; a batch is so many of them, or as many as have the first one's time."""
    if files_a_batch is None:
        store, parts = hadoop_path(spark, f"{path}/part-*")
        times = [x.getModificationTime() for x in store.globStatus(parts)]
        files_a_batch = max(1, times.count(min(times, default=0)))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def run_to_end(stream: DataFrame, write: Callable[[DataFrame, int], None], runs: int = 2) -> None:
    """Runs the stream over all that its source has, and again from the checkpoint, which finds nothing new."""
    checkpoint = shared_folder(stream.sparkSession, "checkpoint")
    for _ in range(runs):
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()


def replayed(rows: DataFrame, order: str, make: Callable[[DataFrame], DataFrame], key: str, by: str | None = None, files: int = 4) -> DataFrame:
    """The table of what the stream make(source) gives for the rows in their order. A row's key keeps it single."""
    spark = rows.sparkSession
    stream = make(source(spark, arrival_files(rows, order, files), rows.schema))
    path = f"{shared_folder(spark, 'replayed')}/table"
    run_to_end(stream, into_table(path, key, by))
    out = read_table(spark, path, stream.schema)
    return out if out is not None else spark.createDataFrame([], stream.schema)


def observed_delay(stream: DataFrame, ts: str = "ts", seen: str = "seen_at", name: str = "detection_delay") -> DataFrame:
    """The stream, with the figures of stats.detection_delay() observed of each micro-batch: query.lastProgress["observedMetrics"][name]."""
    from ..operators.stats import delay_metrics

    delay = F.greatest(F.lit(0), F.unix_millis(seen) - F.unix_millis(ts))
    n, *rest = delay_metrics(delay, F.struct(seen, ts))
    return stream.observe(name, n, *rest)
