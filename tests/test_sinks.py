import pytest
from pyspark.sql import functions as F

from assayer.sinks import tables


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_upsert(spark):
    old = spark.createDataFrame([("a", "one", 1), ("b", "two", 2), ("c", "three", 3)], "stem string, caption string, n int")
    new = spark.createDataFrame([("a", "new"), ("b", ""), ("d", "four")], "stem string, caption string")
    got = {r.stem: (r.caption, r.n) for r in tables.upsert(old, new, ["stem"], F.col("caption") == "").collect()}
    assert got == {"a": ("new", 1), "c": ("three", 3), "d": ("four", None)}


def test_create_guards(spark):
    old = spark.createDataFrame([("a",)], "slug string")
    assert tables.created(old, spark.createDataFrame([("b",)], "slug string"), "slug").count() == 2
    with pytest.raises(Exception, match="exists already: a"):
        tables.created(old, spark.createDataFrame([("a",)], "slug string"), "slug").collect()


def test_versions_and_names(spark):
    taken = spark.createDataFrame([("x", 1), ("x", 2), ("x", 4), ("y", 3)], "stem string, version int")
    wanted = spark.createDataFrame([("x",), ("y",), ("z",)], "stem string")
    assert rows(tables.next_free_version(wanted, taken)) == [("x", 3), ("y", 1), ("z", 1)]
    panels = spark.createDataFrame([("s.jpg", 3)], "sheet string, ord long")
    assert tables.panel_plan(panels).first().file == "s_03.png"


def test_crops(spark):
    gray = [[float(x + 100 * y) for x in range(50)] for y in range(60)]
    df = spark.createDataFrame([(gray, 5, 10, 45, 60), (gray, 0, 0, 10, 10)], "gray array<array<double>>, left int, top int, right int, bottom int")
    a, b = tables.crops(df).collect()
    assert a.applied and len(a.gray) == 50 and a.gray[0][0] == 1005.0 and len(a.gray[0]) == 40
    assert not b.applied and len(b.gray) == 60


def test_written_manifests(spark, tmp_path):
    tables.write_manifests(spark.createDataFrame([("a", 1)], "slug string, n int"), str(tmp_path / "m"))
    assert rows(spark.read.json(str(tmp_path / "m"), schema="slug string, n int")) == [("a", 1)]
    tables.report(spark.createDataFrame([(12.5, "ok", "f")], "score double, reason string, name string"), str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).first().value.split() == ["12.5", "ok", "f"]
