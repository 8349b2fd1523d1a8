"""Jobs as streams: log lines from a folder, the whole state of each job, and what a follower of a log gets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import logs

LINES = "job string, line_no long, line string"


def log_source(spark: SparkSession, folder: str, files_a_trigger: int = 64) -> DataFrame:
    """A stream of (job, line_no, line) from JSON lines that processes append as files to a folder."""
    return spark.readStream.schema(LINES).option("maxFilesPerTrigger", files_a_trigger).json(folder)


def state(lines: DataFrame, totals: DataFrame | None = None, job: str = "job", order: str = "line_no", least: int = 1) -> DataFrame:
    """All that is known of every job: stage, encoded, kind, current, step, steps, total and percent.

    The figures are those of logs.progress; each is a maximum by line number or a count, so a job's state is one small
    row of a streaming aggregation and lines may come late. `totals` (job, total) is a static table; without it a job
    has at least `least` files.
    """
    found = logs.folded(lines, job, order).drop("lines")
    known = found.withColumn("total", F.lit(least).cast("long")) if totals is None else found.join(totals, job, "left").na.fill({"total": least})
    done = logs.percent(F.col("stage"), F.col("encoded"), F.col("total"), F.col("step"), F.col("steps"))
    return known.withColumn("percent", done).withColumn("total", F.greatest("total", "encoded"))


def follow(stream: DataFrame, write, checkpoint: str, every: str = "300 milliseconds", once: bool = False):
    """Hands each batch of a stream to `write(batch, number)`, on a schedule or once for what is there; gives the query.

    The checkpoint remembers how far it came, so a follower that is lost goes on where it stopped.
    """
    writer = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def running(spark: SparkSession, name: str) -> bool:
    """Whether a stream of this name is active: at most one job of a kind runs at a time."""
    return any(q.name == name for q in spark.streams.active)


def single_flight(spark: SparkSession, name: str, start):
    """start() unless a stream of this name is active."""
    if running(spark, name):
        raise RuntimeError(f"already running: {name}")
    return start()
