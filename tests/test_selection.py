import math

import pytest
from pyspark.sql import functions as F

from assayer.operators import selection


def test_settings(spark):
    row = spark.sql("SELECT map('a', '1', 'token', '') AS d, map('a', CAST(NULL AS string), 'token', 'x', 'zz', 'y') AS s")
    got = row.select(selection.overlaid(F.col("d"), F.col("s")).alias("m"))
    assert got.first().m == {"a": "1", "token": "x"}
    assert got.select(selection.redacted(F.col("m"), ("token",))).first()[0] == {"a": "1", "token": "set"}
    assert got.select(selection.missing(F.col("m"), ("a", "b", "token"))).first()[0] == ["b"]


def test_first_of_equal_but_for_case(spark):
    df = spark.createDataFrame([("C:/A", 2), ("c:/a", 1), ("d", 3)], "path string, ord int")
    assert {r.path for r in selection.first_of(df, [F.lower("path")]).collect()} == {"c:/a", "d"}


def test_skipped_panels(spark):
    boxes = spark.createDataFrame([("s", 1), ("s", 2), ("t", 1)], "sheet string, ord int")
    skip = lambda *rows: spark.createDataFrame(rows, "sheet string, ord int")
    assert [(r.sheet, r.ord, r.panels) for r in selection.without_skipped(boxes, skip(("s", 1))).orderBy("sheet").collect()] == [("s", 2, 1), ("t", 1, 1)]
    with pytest.raises(Exception, match="no panel left of t"):
        selection.without_skipped(boxes, skip(("t", 1))).collect()


def test_all_selected(spark):
    df = spark.createDataFrame([("a", True), ("a", None), ("b", True)], "folder string, selected boolean")
    assert dict(map(tuple, selection.all_selected(df, ["folder"]).collect())) == {"a": False, "b": True}


def test_euler_angles(spark):
    a = math.radians(30)
    turn = [[math.cos(a), -math.sin(a), 0.0], [math.sin(a), math.cos(a), 0.0], [0.0, 0.0, 1.0]]
    r = spark.createDataFrame([(turn,)], "r array<array<double>>").select(selection.euler(F.col("r"))).first()[0]
    assert (round(r.x, 9), round(r.y, 9), round(r.z, 9)) == (0, 0, 30)
