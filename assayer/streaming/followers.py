"""Followers of job logs: each gets the lines it hasn't got, the end of the job once, and an end of its own when nothing comes.

A follower of a job is a key of a stateful operator, whose state is the last line it got and the ticks without a line. Each line
puts its timer off by a tick. A timer that expires tells the follower that the job is idle; after more than `ticks` of them it is
cut off. The end of a job, and being cut off, free the state and the timer.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Statuses that end a job, milliseconds of a tick, and idle ticks that a follower stays for.
ENDS, TICK, IDLE = ("done", "error"), 250, 5
EVENTS = "follower string, job string, event string, line_no long, line string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Follower(StatefulProcessor):
    def __init__(self, tick: int = TICK, ticks: int = IDLE):
        self.tick, self.ticks = tick, ticks

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("follower", "last long, idle int")

    def put_off(self, now: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(now + self.tick)

    def free(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.state.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = self.state.get()[0] if self.state.exists() else -1
        ended = None
        for r in sorted(rows, key=lambda r: (r.line_no, r.status is not None)):
            if r.status in ENDS:
                ended = ended or r
            elif r.line_no > last:
                last = r.line_no
                yield Row(follower=key[0], job=key[1], event="line", line_no=r.line_no, line=r.line)
        if ended:
            yield Row(follower=key[0], job=key[1], event=ended.status, line_no=ended.line_no, line=ended.line)
            self.free()
        else:
            self.state.update((last, 0))
            self.put_off(timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last, idle = self.state.get() if self.state.exists() else (-1, 0)
        idle += 1
        if idle > self.ticks:
            yield Row(follower=key[0], job=key[1], event="cut", line_no=last, line=None)
            self.state.clear()
        else:
            yield Row(follower=key[0], job=key[1], event="idle", line_no=last, line=None)
            self.state.update((last, idle))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.tick)

    def close(self) -> None:
        pass


def followed(lines: DataFrame, followers: DataFrame, tick: int = TICK, ticks: int = IDLE) -> DataFrame:
    """(follower, job, event, line_no, line) of a stream of lines (job, line_no, line, status) and a table (follower, job).

    `status` is null for lines; a row with "done" or "error" ends its job, once for each follower. Lines that came already are not
    sent again. Events are line, done, error, idle and cut. State is kept in RocksDB, which this sets where the session names none.
    """
    spark = lines.sparkSession
    if "RocksDB" not in spark.conf.get(PROVIDER, ""):
        spark.conf.set(PROVIDER, ROCKS)
    pairs = lines.join(followers.select("follower", "job").distinct(), "job").select("follower", "job", "line_no", "line", "status")
    return pairs.groupBy("follower", "job").transformWithState(Follower(tick, ticks), EVENTS, "append", "ProcessingTime")


def ends(statuses: DataFrame) -> DataFrame:
    """Rows (job, line_no, line, status) that end jobs, of (job, status, message): they come after all lines."""
    return statuses.where(F.col("status").isin(*ENDS)).select("job", F.lit((1 << 63) - 1).alias("line_no"), F.col("message").alias("line"), "status")
