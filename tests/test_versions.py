"""Writes that are published whole or not at all, and what concurrent and failing ones leave behind."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from assayer.sinks import versions


def files_below(path):
    return sorted(os.path.join(d, n) for d, _, names in os.walk(path) for n in names)


def slugs(spark, path, version=None):
    return sorted(r.slug for r in versions.read(spark, path, version).collect())


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versions.read(spark, path) is None and versions.latest(path) == 0
    assert versions.create(spark.createDataFrame([("a", 1), ("b", 2)], "slug string, n long"), path, "slug") == 1
    assert versions.create(spark.createDataFrame([("c", 3)], "slug string, n long"), f"file://{path}", "slug") == 2
    assert slugs(spark, path) == ["a", "b", "c"] and slugs(spark, path, 1) == ["a", "b"]
    assert versions.replace(path, lambda t: t.where("n > 1").withColumn("n", F.col("n") * 10), spark) == 3
    assert sorted(map(tuple, versions.read(spark, path).collect())) == [("b", 20), ("c", 30)]
    assert versions.entry(path, 3)["rows"] == 2
    plan = versions.read(spark, path).where("n > 25").select("slug")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(n), GreaterThan(n,25)]" in plan and "FileScan parquet" in plan
    assert versions.vacuum(path, older=0) == 4 and slugs(spark, path) == ["b", "c"] and len(files_below(path + "/versions")) == 1
    empty = spark.createDataFrame([], "slug string, n long")
    assert versions.replace(path, lambda t: empty, spark) == 4 and versions.read(spark, path).count() == 0
    with pytest.raises(ValueError, match="opened"):
        versions.latest("s3a://bucket/t")


def test_a_taken_key_fails_the_whole_write(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.create(spark.createDataFrame([("a", 1)], "slug string, n long"), path, "slug")
    before = files_below(path)
    for rows in ([("x", 1), ("a", 2)], [("y", 1), (None, 2)]):
        with pytest.raises(Exception, match="exists already"):
            versions.create(spark.createDataFrame(rows, "slug string, n long").repartition(2), path, "slug")
        assert files_below(path) == before and slugs(spark, path) == ["a"]


def test_two_creations_of_one_slug(spark, tmp_path):
    path, results = str(tmp_path / "t"), []
    barrier = threading.Barrier(4)

    def make(k):
        barrier.wait()
        try:
            versions.create(spark.createDataFrame([("same", k), (f"own{k}", k)], "slug string, n long"), path, "slug")
            results.append(k)
        except Exception as e:
            results.append(str(e))

    threads = [threading.Thread(target=make, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    won = [r for r in results if isinstance(r, int)]
    assert len(won) == 1 and sum("exists already" in str(r) for r in results) == 3
    assert sorted(map(tuple, versions.read(spark, path).collect())) == [(f"own{won[0]}", won[0]), ("same", won[0])]
    assert len(os.listdir(path + "/data")) == 1


def test_writers_of_other_keys_all_succeed(spark, tmp_path):
    path, errors = str(tmp_path / "t"), []

    def make(k):
        try:
            versions.create(spark.createDataFrame([(f"own{k}",)], "slug string"), path, "slug")
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=make, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and slugs(spark, path) == ["own0", "own1", "own2"] and versions.latest(path) == 3


def test_a_write_made_from_an_old_version_is_refused(spark, tmp_path):
    path, rows = str(tmp_path / "t"), spark.createDataFrame([("a",)], "slug string")
    versions.publish(rows, path, 0)
    before = files_below(path)
    with pytest.raises(versions.Conflict):
        versions.publish(rows, path, 0)
    assert files_below(path) == before


def test_a_killed_task_leaves_nothing(spark, tmp_path):
    """One task's Python process dies after it has staged files of its rows; others have ended by then."""
    path = str(tmp_path / "t")

    def dying(batches):
        import time

        from pyspark import TaskContext

        for b in batches:
            yield b
        if TaskContext.get().partitionId() == 2:
            time.sleep(1)
            os.kill(os.getpid(), 9)

    rows = spark.range(0, 400, 1, 4).select(F.concat(F.lit("s"), "id").alias("slug"), F.encode(F.col("id").cast("string"), "UTF-8").alias("content"))
    with pytest.raises(Exception):  # noqa: B017  whatever Spark says of a lost worker
        versions.publish(rows.mapInArrow(dying, rows.schema), path, 0, content="content")
    assert files_below(path) == [] and versions.read(spark, path) is None
    versions.publish(rows, path, 0, content="content")
    back = versions.read(spark, path).collect()
    assert len(back) == 400
    for r in back[::37]:
        with open(os.path.join(path, r.content)) as f:
            assert f"s{f.read()}" == r.slug


def test_files_of_lost_attempts_are_not_listed(spark, tmp_path):
    path = str(tmp_path / "t")
    writer = versions.VersionWriter({"path": path, "base": "0", "write": "w"}, spark.range(1).schema)
    os.makedirs(path + "/data/w")
    for name in ("a.parquet", "lost.parquet"):
        open(f"{path}/data/w/{name}", "w").close()
    writer.commit([versions.Staged(["data/w/a.parquet"], 0, 0), None])
    assert os.listdir(path + "/data/w") == ["a.parquet"] and versions.entry(path, 1)["files"] == ["data/w/a.parquet"]


def test_sheets_are_made_together_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "sheets")
    schema = "batch string, slug string, display_name string, error string, created boolean"
    panels = spark.createDataFrame([(s, f"{s}_{k:02}.png", f"{s}{k}".encode()) for s in "abc" for k in range(3)], "slug string, file string, content binary")
    bad = spark.createDataFrame([("1", "a", "A", None, False), ("1", "b", "B", "too few panels", False)], schema)
    with pytest.raises(Exception, match="sheet"):
        versions.create_sheets(bad, panels, path)
    assert files_below(path) == []
    good = spark.createDataFrame([("1", "a", "A", None, True), ("1", "b", "B", None, True)], schema)
    assert versions.create_sheets(good, panels, path) == 1
    rows = versions.read(spark, path).collect()
    assert sorted((r.slug, r.file) for r in rows) == [(s, f"{s}_{k:02}.png") for s in "ab" for k in range(3)]
    assert all(open(os.path.join(path, r.content)).read() == f"{r.slug}{int(r.file[2:4])}" for r in rows)
    before = files_below(path)
    with pytest.raises(Exception, match="exists already"):
        versions.create_sheets(spark.createDataFrame([("2", "c", "C", None, True), ("2", "a", "A", None, True)], schema), panels, path)
    assert files_below(path) == before
