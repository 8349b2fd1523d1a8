"""Progress of jobs from a stream of log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import logs


def progress_stream(lines: DataFrame, job: str = "job", order: str = "line_no") -> DataFrame:
    """The state of every job as its lines come in, from a streaming or static frame (job, line_no, line).

    It is the fold of `logs`, whose state of a job is one small row of an ordinary streaming aggregation, so lines may come
    late or out of order. Use output mode "update" or "complete".
    """
    return logs.folded(lines, job, order).select(job, "stage", "encoded", "step", "lines")


def hourly(events: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """An extension: counts by hour and type, with a watermark for late events."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "event_type", "n")


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Everything that is there, into an in-memory table of this name (for small results)."""
    stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)
