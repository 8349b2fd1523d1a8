"""Refreshes read only what is new or has changed, and drop what is gone."""

import os

from pyspark.sql import functions as F

from assayer.sinks import versions
from assayer.sources import inspections


def listed(spark, folder):
    found = spark.read.format("binaryFile").load(str(folder))
    return found.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def test_only_changed_files_are_read(spark, tmp_path):
    folder, path = tmp_path / "files", str(tmp_path / "table")
    folder.mkdir()
    for k in range(6):
        (folder / f"{k}.bin").write_text(f"head{k}")
    reads = spark.sparkContext.accumulator(0)

    def inspect(files):
        def run(batches):
            for pdf in batches:
                reads.add(len(pdf))
                yield pdf.assign(head=[open(p.removeprefix("file:")).read(5) for p in pdf["path"]])

        return files.mapInPandas(run, "path string, modified timestamp, size long, head string")

    def refresh():
        before = reads.value
        rows = inspections.refreshed(listed(spark, folder), path, inspect).collect()
        return {os.path.basename(r.path): r.head for r in rows}, reads.value - before

    assert refresh() == ({f"{k}.bin": f"head{k}" for k in range(6)}, 6)
    assert refresh()[1] == 0 and versions.latest(path) == 1
    (folder / "6.bin").write_text("fresh")
    got, read = refresh()
    assert len(got) == 7 and read == 1 and versions.latest(path) == 2
    (folder / "0.bin").write_text("other, longer")
    (folder / "1.bin").unlink()
    got, read = refresh()
    assert got == {"0.bin": "other", **{f"{k}.bin": f"head{k}" for k in range(2, 6)}, "6.bin": "fresh"} and read == 1
    assert versions.read(spark, path, 1).count() == 6  # readers of older versions aren't disturbed
    for f in folder.iterdir():
        f.unlink()
    assert inspections.refreshed(spark.createDataFrame([], "path string, modified timestamp, size long"), path, inspect).count() == 0


def test_previews_of_another_side_are_rendered_anew(spark, tmp_path):
    files = spark.createDataFrame([("a", 1, 10), ("b", 1, 20)], "path string, modified long, size long")
    calls = []

    def render(rows):
        calls.append(rows.count())
        return rows.withColumn("preview", F.concat("path", F.col("side").cast("string")))

    path = str(tmp_path / "previews")
    assert {r.preview for r in inspections.previews(files, path, render, 100).collect()} == {"a100", "b100"}
    inspections.previews(files, path, render, 100)
    assert {r.preview for r in inspections.previews(files, path, render, 200).collect()} == {"a200", "b200"}
    assert calls == [2, 0, 2]
