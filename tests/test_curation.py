"""Curation queries against their SQL, and the order-dependent operators against plain Python."""

import glob
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.functions import expressions as X
from assayer.functions import thresholds as T
from assayer.operators import agreement, catalog, geometry, kernels, library, logs, quality
from assayer.plans import curation
from assayer.streaming import progress

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(rows):
    shown = lambda v: f"{float(v):.9g}" if isinstance(v, float) or hasattr(v, "as_tuple") else str(v)
    return sorted(tuple(shown(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(curation.SQL))
def test_query_equals_sql(spark, duck, name):
    got = curation.QUERIES[name](spark, SF)
    want = duck.sql(curation.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert plain(got.select(columns).collect()) == plain(want.select(*(f'"{c}"' for c in columns)).fetchall())


def test_queries_without_sql_run(spark):
    for name in curation.QUERIES.keys() - curation.SQL.keys():
        assert curation.QUERIES[name](spark, SF).count() > 0, name


def test_null_measurements(spark):
    row = spark.sql("SELECT CAST(NULL AS double) AS x")
    assert row.select(X.clamp(F.col("x"))).first()[0] is None
    assert row.select(X.pose_score(F.col("x"), F.col("x"))).first()[0] == 1.0
    assert row.select(X.pose_bin(F.col("x"))).first()[0] == "unknown"
    assert row.select(X.band(F.col("x"))).first()[0] == "skip"


@pytest.mark.parametrize("yaw,want", [(17.99, "front"), (18.0, "three-quarter-right"), (-18.0, "three-quarter-left"), (48.0, "profile-right"), (-50.0, "profile-left")])
def test_pose_bins(spark, yaw, want):
    assert spark.range(1).select(X.pose_bin(F.lit(yaw))).first()[0] == want


def pick(rows):
    """The pick written as a search over whole sets, one step at a time."""
    rows = sorted((r for r in rows if r["score"] and r["score"] > 0), key=lambda r: (-r["score"], r["name"].lower()))
    if len(rows) <= T.PICKS:
        return [r["name"] for r in rows]
    chosen = []
    for p in T.POSES:
        chosen += [r for r in rows if r["scale"] == "closeup" and r["pose_bin"] == p][:1]

    def worth(r):
        d = min(math.hypot(r["yaw"] - c["yaw"], 0.6 * (r["pitch"] - c["pitch"])) for c in chosen) if chosen else 0
        return r["score"] + (10 * min(d / 30, 2.5) - 3 * sum(c["scale"] == r["scale"] for c in chosen) if chosen else 0)

    for scale, quota in [*T.QUOTAS.items(), (None, T.PICKS)]:
        while len(chosen) < T.PICKS and (scale is None or sum(c["scale"] == scale for c in chosen) < quota):
            left = [r for r in rows if r not in chosen and scale in (None, r["scale"])]
            if not left:
                break
            chosen.append(max(left, key=worth))
    return [c["name"] for c in chosen]


def test_diverse_pick(spark):
    rows = curation.customers(spark, "/root/testdata/sf0.01").where("nation < 6")
    got = {}
    for r in quality.pick_diverse(rows, ["nation"]).orderBy("nation", "place").collect():
        got.setdefault(r.nation, []).append(r.name)
    sets = {}
    for r in rows.collect():
        sets.setdefault(r.nation, []).append(r.asDict())
    assert got == {n: pick(rs) for n, rs in sets.items()}


def test_reading_order(spark):
    boxes = [(100, 0, 200, 100), (0, 5, 90, 95), (0, 120, 90, 220), (100, 110, 200, 230)]
    df = spark.createDataFrame([("p", k, *map(float, b)) for k, b in enumerate(boxes)], "page string, ord long, x0 double, y0 double, x1 double, y1 double")
    got = [tuple(int(r[c]) for c in geometry.BOX) for r in geometry.reading_order(df, ["page"]).orderBy("ord").collect()]
    assert got == [boxes[1], boxes[0], boxes[2], boxes[3]]


def test_boxes_merge_within_bounds(spark):
    boxes = [(0, 0, 50, 20), (55, 0, 100, 20), (0, 500, 50, 520), (105, 0, 900, 20)]
    df = spark.createDataFrame([("p", k, *map(float, b)) for k, b in enumerate(boxes)], "page string, ord long, x0 double, y0 double, x1 double, y1 double")
    got = {tuple(int(r[c]) for c in geometry.BOX) for r in geometry.merged_boxes(df, ["page"], 1000, 1000).collect()}
    assert got == {(0, 0, 100, 20), (0, 500, 50, 520), (105, 0, 900, 20)}


def test_consensus(spark):
    box = (0.0, 0.0, 0.5, 0.1)
    rows = [("d", f"f{k}", 0, *box) for k in range(4)] + [("d", "f5", 0, 0.7, 0.7, 0.9, 0.9)]
    files = spark.createDataFrame([("d", f"f{k}") for k in range(8)], "dataset string, file string")
    df = spark.createDataFrame(rows, "dataset string, file string, ord long, x0 double, y0 double, x1 double, y1 double")
    got = agreement.consensus(df, files, ["dataset"]).collect()
    assert {r.file for r in got} == {"f4", "f5", "f6", "f7"} and {r["count"] for r in got} == {4}


def test_sheets_split():
    sheet = np.full((200, 300), 255.0)
    cells = [(0, 0, 90, 95), (100, 0, 190, 95), (200, 0, 300, 95), (0, 105, 140, 200), (150, 105, 300, 200)]
    for x0, y0, x1, y1 in cells:
        sheet[y0:y1, x0:x1] = 40
    assert sorted(geometry.split_sheet(sheet)) == sorted(cells)
    assert geometry.split_sheet(np.full((100, 100), 10.0)) == [(0, 0, 100, 100)]
    assert sorted(geometry.blobs(sheet, least=8)) == sorted(cells)


def test_laplacian_of_reflected_borders(spark):
    px = np.random.default_rng(1).uniform(0, 255, (8, 8))
    p = np.pad(px, 1, mode="reflect")
    want = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * px
    df = spark.createDataFrame([(px.ravel().tolist(),)], "px array<double>")
    assert np.allclose(df.select(kernels.laplacian(F.col("px"), 8, 8)).first()[0], want.ravel())


def test_overruled_stages(spark):
    said = ["[main] loading VAE", "[extract] image x/a.png: ok", "[studio] error: out of memory", "[extract] video b.mp4: ok", "[RUN] identity 3/9"]
    df = spark.createDataFrame([("j", k, x) for k, x in enumerate(said)], "job string, line_no long, line string")
    r = logs.progress(df, spark.createDataFrame([("j", 4), ("k", 2)], "job string, total long")).orderBy("job").collect()
    assert (r[0].stage, r[0].encoded, r[0].current, r[0].kind, r[0].step, r[0].steps, r[0].percent) == ("refining", 2, "b.mp4", "video", 3, 9, 8 + 21 + 7)
    assert (r[1].stage, r[1].percent) == ("starting", 1)


def test_progress_as_a_stream(spark, tmp_path):
    lines = curation.lines(spark, SF)
    lines.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    got = progress.run_once(progress.progress_stream(stream), "progress_test", str(tmp_path / "state"))
    assert plain(got.collect()) == plain(progress.progress_stream(lines).collect())


def test_hours_of_a_stream(spark, tmp_path):
    events = spark.readStream.schema(spark.read.parquet(f"{SF}/events.parquet").schema).parquet(f"{SF}/events*.parquet")
    got = progress.run_once(progress.hourly(events), "hours_test", str(tmp_path / "state"))
    assert got.agg(F.sum("n")).first()[0] == 1000


def test_lookup_falls_through_empty_values(spark):
    index = spark.createDataFrame([("a", "1", 1), ("a", "", 2), ("b", "2", 1)], "key string, value string, ord long")
    rows = spark.createDataFrame([("a", "b"), ("z", "z")], "first string, second string")
    assert [r.found for r in library.lookup(rows, index, ("first", "second")).orderBy("first").collect()] == ["2", None]


def test_patch_keeps_leftovers(spark):
    old = spark.createDataFrame([("s", "a", 1, "front", "", False), ("s", "b", 2, "", "flagged", False)], "slug string, file string, pos long, shot string, clean string, enabled boolean")
    new = spark.createDataFrame([("s", "b", 1, None, None, None), ("s", "gone", 2, None, None, None)], "slug string, file string, pos long, shot string, clean string, enabled boolean")
    got = [(r.file, r.clean, r.enabled) for r in catalog.reordered(old, new).orderBy("pos").collect()]
    assert got == [("b", "flagged", True), ("a", "", True)]


def test_rows_that_can_not_be_picked_change_nothing(spark):
    import random

    rng = random.Random(6)
    rows = [("g", f"n{k:03}", round(rng.choice([rng.uniform(0, 100), rng.uniform(0, 20)]), 1), rng.uniform(-60, 60), rng.uniform(-20, 20), rng.choice(["closeup", "closeup", "medium"]),
             rng.choice([*T.POSES, "unknown"])) for k in range(400)]
    rows += [("h", f"m{k}", 90.0 - k, 0.0, 0.0, "closeup", "front") for k in range(10)] + [("h", "m", 1.0, 50.0, 0.0, "closeup", "profile-right")]
    df = spark.createDataFrame(rows, "nation string, name string, score double, yaw double, pitch double, scale string, pose_bin string")
    assert quality.can_be_picked(df.where("nation = 'g'"), ["nation"], "name", 10).count() < 400
    for g in "gh":
        got = [r.name for r in quality.pick_diverse(df, ["nation"]).where(F.col("nation") == g).orderBy("place").collect()]
        assert got == pick([dict(zip(("nation", "name", "score", "yaw", "pitch", "scale", "pose_bin"), r, strict=True)) for r in rows if r[0] == g])


def test_few_rows_of_many_reach_the_pick(spark):
    """Rows whose scores fall off, as those of stills do, ties and missing poses among them; the pick stays what it is."""
    rng = np.random.default_rng(5)
    n = 60_000
    score = np.round(100 * rng.beta(2, 4, n), 1)
    yaw, pitch = rng.normal(0, 25, n).round(1), rng.normal(0, 10, n).round(1)
    scale, pose = rng.choice(["closeup", "medium", "full"], n), rng.choice([*T.POSES, "unknown"], n)
    rows = [("g", f"n{k}", float(score[k]), None if k % 97 == 0 else float(yaw[k]), None if k % 89 == 0 else float(pitch[k]), None if k % 83 == 0 else str(scale[k]), str(pose[k])) for k in range(n)]
    df = spark.createDataFrame(rows, "nation string, name string, score double, yaw double, pitch double, scale string, pose_bin string").where("score > 0").repartition(8)
    left = quality.can_be_picked(df, ["nation"], "name", T.PICKS).toPandas()
    assert len(left) < 800
    every = df.toPandas().assign(_l=lambda p: p["name"].str.lower()).sort_values(["score", "_l", "name"], ascending=[False, True, True]).reset_index(drop=True)
    got = quality.pick_diverse(df, ["nation"]).orderBy("place").collect()
    assert [r.name for r in got] == list(every["name"].iloc[quality.greedy(every, T.PICKS, T.QUOTAS)])


def test_pick_with_many_ties(spark):
    """Grids of equal scores, where only names and distances decide, and groups of n and n + 1 rows."""
    rows = [("g", f"n{k:04}", 50.0 + k % 2, float(k % 41 - 20), float(k % 23 - 11), ["closeup", "medium"][k % 3 == 0], [*T.POSES][k % 5]) for k in range(1500)]
    rows += [(g, f"m{k}", 90.0 - 5 * k, float(9 * k), 0.0, "closeup", "front") for g, m in (("h", 10), ("i", 11), (None, 12)) for k in range(m)]
    df = spark.createDataFrame(rows, "nation string, name string, score double, yaw double, pitch double, scale string, pose_bin string")
    got = quality.pick_diverse(df, ["nation"]).collect()
    for g in ("g", "h", "i", None):
        mine = [dict(zip(("nation", "name", "score", "yaw", "pitch", "scale", "pose_bin"), r, strict=True)) for r in rows if r[0] == g]
        assert [r.name for r in sorted((r for r in got if r.nation == g), key=lambda r: r.place)] == pick(mine)
