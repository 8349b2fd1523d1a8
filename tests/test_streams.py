"""The source of log lines over appends, restarts and rotations, and followers with an end."""

import os
import threading
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from assayer.sources import joblogs
from assayer.streaming import followers


def once(stream, out, checkpoint):
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(out)


def append(path, text):
    with open(path, "a") as f:
        f.write(text)


def test_lines_come_exactly_once_over_restarts_and_rotation(spark, tmp_path):
    logs, out, checkpoint = (str(tmp_path / x) for x in ("logs", "out", "checkpoint"))
    os.makedirs(logs)
    append(f"{logs}/a.log", "one\ntwo\n\nhal")
    append(f"{logs}/b.log", "x\r\n")
    append(f"{logs}/c.log", "no end")
    stream = lambda: joblogs.log_lines(spark, logs, chunk=3)
    got = once(stream(), out, checkpoint)
    assert sorted((r.job, r.line) for r in got.collect()) == [("a", "one"), ("a", "two"), ("b", "x")]
    append(f"{logs}/a.log", "f\nthree\n")
    os.rename(f"{logs}/a.log", f"{logs}/a.log.1")
    append(f"{logs}/a.log", "fresh\n")
    append(f"{logs}/a.log.1", "late\n")
    append(f"{logs}/c.log", "\n")
    once(stream(), out, checkpoint)
    os.rename(f"{logs}/a.log.1", f"{logs}/a.log.2")
    os.rename(f"{logs}/a.log", f"{logs}/a.log.1")
    append(f"{logs}/a.log", "newest é\n")
    once(stream(), out, checkpoint)
    once(stream(), out, checkpoint)
    got = spark.read.parquet(out).orderBy("job", "line_no").collect()
    assert [(r.job, r.line) for r in got] == [("a", t) for t in ("one", "two", "half", "three", "late", "fresh", "newest é")] + [("b", "x"), ("c", "no end")]


def test_lines_appended_while_the_stream_runs(spark, tmp_path):
    logs, out, checkpoint = (str(tmp_path / x) for x in ("logs", "out", "checkpoint"))
    os.makedirs(logs)
    append(f"{logs}/j0.log", "j0 start\n")

    def write():
        for k in range(300):
            append(f"{logs}/j{k % 3}.log", f"line {k} ")
            append(f"{logs}/j{k % 3}.log", f"of {k % 3}\n")
            time.sleep(0.01)

    def start():
        return joblogs.log_lines(spark, logs).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(processingTime="200 milliseconds").start()

    writer = threading.Thread(target=write)
    writer.start()
    query = start()
    time.sleep(2)
    query.stop()  # while lines are written
    query = start()
    writer.join()
    query.processAllAvailable()
    query.stop()
    got = spark.read.parquet(out).collect()
    assert Counter(r.line for r in got) == Counter([f"line {k} of {k % 3}" for k in range(300)] + ["j0 start"])
    assert [r.line for r in sorted(got, key=lambda r: r.line_no) if r.job == "j1"] == [f"line {k} of 1" for k in range(1, 300, 3)]


def test_lines_that_are_gone_fail(spark, tmp_path):
    reader = joblogs.LogReader({"path": str(tmp_path)})
    append(tmp_path / "a.log", "one\ntwo\n")
    end = reader.latestOffset()
    (part,) = reader.partitions(reader.initialOffset(), end)
    assert [x for b in reader.read(part) for x in b.column("line").to_pylist()] == ["one", "two"]
    os.unlink(tmp_path / "a.log")
    with pytest.raises(RuntimeError, match="gone"):
        reader.partitions(reader.initialOffset(), end)
    with pytest.raises(RuntimeError, match="gone"):
        list(reader.read(part))
    assert reader.partitions(end, end) == [] and reader.latestOffset() == {"files": {}}


def test_chunks_cut_between_lines(tmp_path):
    lines = [f"{'y' * (k % 7)}{k}" for k in range(50)]
    append(tmp_path / "a.log", "\n".join(lines) + "\n")
    for chunk in (1, 2, 5, 64, 10_000):
        reader = joblogs.LogReader({"path": str(tmp_path), "chunk": str(chunk)})
        parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
        assert [x for p in parts for b in reader.read(p) for x in b.column("line").to_pylist()] == lines


def wait_for(query, seen, condition, seconds=60):
    until = time.time() + seconds
    while not condition(seen) and time.time() < until:
        assert query.exception() is None, query.exception()
        time.sleep(0.2)
    assert condition(seen), seen


def test_followers_end(spark, tmp_path):
    schema = "job string, line_no long, line string, status string"
    source = tmp_path / "in"
    source.mkdir()

    def put(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))

    put([("ends", 0, "a", None), ("ends", 1, "b", None), ("silent", 0, "s", None), ("alone", 0, "nobody follows", None)])
    stream = spark.readStream.schema(schema).parquet(str(source))
    who = spark.createDataFrame([("f", "ends"), ("g", "ends"), ("f", "silent")], "follower string, job string")
    seen = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        query = followers.followed(stream, who, tick=400, ticks=5).writeStream.outputMode("append").foreachBatch(
            lambda b, n: seen.extend(tuple(r) for r in b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
        wait_for(query, seen, lambda s: sum(e[2] == "line" for e in s) >= 5)
        put([("ends", 1, "b", None), ("ends", 2, "c", None)])
        wait_for(query, seen, lambda s: sum(e[3] == 2 and e[2] == "line" for e in s) >= 2)
        put([r for r in followers.ends(spark.createDataFrame([("ends", "error", "boom"), ("silent", "running", "-")], "job string, status string, message string")).collect()])
        wait_for(query, seen, lambda s: any(e[2] == "cut" for e in s) and sum(e[2] == "error" for e in s) >= 2)
        wait_for(query, seen, lambda s: query.lastProgress and sum(o.numRowsTotal for o in query.lastProgress.stateOperators) == 0)
        query.stop()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    for f in "fg":
        mine = [e for e in seen if e[:2] == (f, "ends") and e[2] != "idle"]
        assert [(e[2], e[4]) for e in mine] == [("line", "a"), ("line", "b"), ("line", "c"), ("error", "boom")]
    silent = [e[2] for e in seen if e[1] == "silent"]
    assert silent == ["line"] + ["idle"] * 5 + ["cut"] and not any(e[1] == "alone" for e in seen)
