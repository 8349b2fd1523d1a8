"""Jobs as streams, sinks that read back, and plans that fail as a whole."""

import json

import pytest
from pyspark.sql import functions as F

from assayer.functions import paths as P
from assayer.operators import library, listing, logs, manifests
from assayer.sinks import tables as sinks
from assayer.sources import files
from assayer.streaming import jobs


def test_stream_and_table_agree(spark, tmp_path):
    said = [("a", 0, "[main] loading VAE"), ("a", 1, "[extract] image x/b1.png: ok"), ("b", 0, "[studio] error: x"), ("b", 1, "[run] identity 2/9"),
            ("a", 2, "[extract] video x/c.mp4: ok"), ("c", 0, "nothing"), ("a", 3, "token cap reached")]
    (tmp_path / "in").mkdir()
    for k, part in enumerate((said[:3], said[3:])):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("job", "line_no", "line"), r, strict=True))) for r in part))
    seen = {}
    stream = jobs.state(jobs.log_source(spark, str(tmp_path / "in"), 1))
    query = jobs.follow(stream, lambda batch, n: seen.update({r.job: r for r in batch.collect()}), str(tmp_path / "checkpoint"), once=True)
    query.awaitTermination()
    table = spark.createDataFrame(said, jobs.LINES)
    want = {r.job: r for r in jobs.state(table).collect()}
    assert seen == want and want["a"].stage == "fitting" and want["a"].kind == "video" and want["b"].stage == "refining" and want["c"].stage == "starting"
    assert {r.job: r.percent for r in logs.progress(table, table.select("job").distinct().withColumn("total", F.lit(4).cast("long"))).collect()}["b"] == 8 + int(84 / 4 * 2 / 9)


def test_a_running_job_is_not_started_twice(spark, tmp_path):
    stream = spark.readStream.format("rate").load().groupBy().count()
    query = stream.writeStream.outputMode("complete").format("noop").queryName("one_job").option("checkpointLocation", str(tmp_path)).start()
    try:
        with pytest.raises(RuntimeError):
            jobs.single_flight(spark, "one_job", lambda: None)
    finally:
        query.stop()
    assert jobs.single_flight(spark, "one_job", lambda: 7) == 7


def test_sinks_read_back(spark, tmp_path):
    rows = spark.sql("SELECT 'a' AS slug, 'A' AS display_name, CAST(NULL AS string) AS notes")
    back = sinks.save_manifests(rows, str(tmp_path / "m"))
    assert back.collect() == rows.collect()
    data = spark.sql("SELECT 'a' AS slug, CAST(NULL AS struct<output:string,at:string,content_hash:string>) AS last_extract UNION ALL SELECT 'b', named_struct('output', 'o', 'at', 't', 'content_hash', 'h')")
    done = spark.sql("SELECT 'a' AS slug, 'x' AS output, 'now' AS at, 'hash' AS hash")
    assert {r.slug: tuple(r.last_extract) for r in sinks.recorded(data, done).collect()} == {"a": ("x", "now", "hash"), "b": ("o", "t", "h")}
    cleaned = spark.sql("SELECT 1 AS id, 'cleaned' AS clean, array(1) AS gray UNION ALL SELECT 2, 'cleaned', array(2) UNION ALL SELECT 3, 'flagged', array(3)")
    kept = spark.sql("SELECT 1 AS id, array(9) AS gray UNION ALL SELECT 3, array(9)")
    assert {r.id: (r.clean, r.gray, r.restored) for r in sinks.undone(cleaned, kept, ["id"]).collect()} == {
        1: ("flagged", [9], True), 2: ("cleaned", [2], False), 3: ("flagged", [3], False)}


def test_errors_stop_writes(spark):
    data = spark.sql("SELECT 's' AS slug, 'x' AS display_name, 'identity' AS concept_type")
    with pytest.raises(Exception, match="unknown concept"):
        manifests.patched(data, spark.sql("SELECT 's' AS slug, 'odd' AS concept_type")).collect()
    with pytest.raises(Exception, match="must be a number"):
        spark.range(1).select(manifests.extract_settings(F.create_map(F.lit("pool"), F.lit("x")))).collect()
    with pytest.raises(Exception, match="unknown: 9"):
        listing.lookup_one(spark.range(3), "id", 9).collect()
    folders = spark.createDataFrame([("a",), ("a/b",), ("c",)], "folder string")
    assert sorted(r.folder for r in library.renamed(folders, "a", "d/e").collect()) == ["c", "d/e", "d/e/b"]
    for old, new in (("a", "a/b/c"), ("", "x")):
        with pytest.raises(ValueError):
            library.renamed(folders, old, new)
    for old, new in (("x", "y"), ("a", "c")):
        with pytest.raises(Exception, match="no folder|exists"):
            library.renamed(folders, old, new).collect()
    with pytest.raises(Exception, match="not a file name"):
        spark.range(1).select(P.file_name(F.lit("x/.."))).collect()


def test_advice_is_normalised(spark):
    raw = "array(named_struct('id', 'a', 'level', 'odd', 'text', ' x '), named_struct('id', 'b', 'level', 'need', 'text', ' '), named_struct('id', CAST(NULL AS string), 'level', 'ok', 'text', 'y'))"
    got = spark.range(1).select(manifests.advice(F.expr(raw)).alias("a")).first().a
    assert [tuple(r) for r in got] == [("a", "improve", "x"), ("", "ok", "y")]


def test_uploads_and_walks(spark):
    rows = files.uploads(spark, [("x/a.PNG", b"1"), ("b.txt", b"2"), ("c.mp4", b"3")])
    assert [(r.ord, r.file, bytes(r.content)) for r in rows.orderBy("ord").collect()] == [(0, "a.PNG", b"1"), (2, "c.mp4", b"3")]
    found = spark.createDataFrame([(p,) for p in ("file:/.root/m/a.safetensors", "file:/.root/m/.git/b.safetensors", "file:/.root/m/x/.h/c.safetensors", "file:/.root/m/x/d.safetensors")], "path string")
    assert sorted(r.below for r in files.walked(found, "file:///.root/m").collect()) == ["a.safetensors", "x/d.safetensors"]


def test_a_real_log(spark):
    """Lines as jobs write them: the error, the tag before a step, a mere "identity 3/9" that says nothing, and the last status."""
    said = ["[studio] python extract.py --mode training", "[RefPack] loading VAE from /models/vae", "[extract] image /data/a/01.png: 768x768", "[RefPack] identity 3/40",
            "identity 39/40", "[extract] video /data/a/clip 2.mp4: 33 frames", "[studio] error: extractor exited with 1"]
    lines = spark.createDataFrame([("j", k, t) for k, t in enumerate(said)] + [("k", k, t) for k, t in enumerate(said[:4])], jobs.LINES)
    totals = spark.createDataFrame([("j", 2, "running"), ("k", 2, "running"), ("none", 5, "running")], "job string, total long, status string")
    got = {r.job: r for r in logs.progress(lines, totals).collect()}
    assert (got["j"].stage, got["j"].percent, got["j"].encoded, got["j"].current, got["j"].kind) == ("error", 0, 2, "clip 2.mp4", "video")
    assert (got["k"].stage, got["k"].step, got["k"].steps, got["k"].percent) == ("refining", 3, 40, 8 + int(42 * 3 / 40))
    assert (got["none"].stage, got["none"].percent) == ("starting", 1)
    for status, want in (("done", ("saved", 100)), ("error", ("error", 0))):
        rows = logs.progress(lines, totals.withColumn("status", F.lit(status))).collect()
        assert {(r.stage, r.percent) for r in rows} == {want}
    other = logs.Patterns(error="boom", identity=r"step (\d+) of (\d+)")
    odd = spark.createDataFrame([("x", 0, "boom"), ("x", 1, "step 2 of 4")], jobs.LINES)
    assert logs.folded(odd, patterns=other).select("stage", "step", "steps").first() == ("refining", 2, 4)
