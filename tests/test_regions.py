"""Regions of masks against the union of runs in one process, tiles, and ways of any length."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.operators import components, geometry, regions


def lined(spark, masks):
    rows = [(name, y, line.tolist()) for name, m in masks.items() for y, line in enumerate(m)]
    return spark.createDataFrame(rows, "sheet string, y int, line array<boolean>")


def spiral(n):
    m = np.zeros((n, n), bool)
    x = y = 0
    dx, dy, left, top, right, bottom = 1, 0, 0, 0, n - 1, n - 1
    while left <= right and top <= bottom:
        m[top, left : right + 1] = True
        m[top : bottom + 1, right] = True
        if bottom > top:
            m[bottom, left : right + 1] = True
        if left + 2 <= right:
            m[top + 2 : bottom + 1, left] = True
            m[top + 2, left : left + 2] = True
        left, top, right, bottom = left + 2, top + 2, right - 2, bottom - 2
    return m


def plain(masks, **options):
    return sorted((name, *map(int, b)) for name, m in masks.items() for b in geometry.blobs(np.where(m, 0.0, 255.0), **options))


def boxes(df):
    return sorted((r.sheet, r.x0, r.y0, r.x1, r.y1) for r in df.collect())


@pytest.fixture(scope="module")
def masks():
    rng = np.random.default_rng(4)
    return {"sparse": rng.random((30, 90)) < 0.35, "dense": rng.random((25, 150)) < 0.6, "spiral": spiral(17), "empty": np.zeros((5, 9), bool),
            "full": np.ones((7, 140), bool), "wide": rng.random((1, 200)) < 0.5, "high": rng.random((60, 1)) < 0.7}


def test_against_one_process(spark, masks):
    assert boxes(regions.regions(lined(spark, masks).repartition(5), ["sheet"])) == plain(masks)
    large = regions.regions(lined(spark, masks), ["sheet"], area=6, least=2).cache()
    assert boxes(large) == plain(masks, area=6, least=2) and large.where("pixels < 6").isEmpty()
    got = regions.regions(lined(spark, {k: masks[k] for k in ("dense", "full")}), ["sheet"]).groupBy("sheet").agg(F.sum("pixels").alias("n")).collect()
    assert {r.sheet: r.n for r in got} == {k: int(m.sum()) for k, m in masks.items() if k in ("dense", "full")}


def test_tiles_are_joined_across_their_borders(spark, masks):
    rows = [(name, y, x, line[x : x + 16].tolist()) for name, m in masks.items() for y, line in enumerate(m) for x in range(0, m.shape[1], 16)]
    tiled = spark.createDataFrame(rows, "sheet string, y int, x int, line array<boolean>")
    assert boxes(regions.regions(tiled, ["sheet"], "x")) == plain(masks)


def test_opening(spark, masks):
    lines = lined(spark, masks)
    assert boxes(regions.regions(regions.opened(lines, ["sheet"]), ["sheet"])) == plain(masks, opening=True)


def test_nulls_and_empty_tables(spark):
    lines = spark.createDataFrame([(None, 0, [True, None, True]), (None, 2, [True, True]), (None, 3, [False, True]), ("a", 0, []), ("b", 0, None)], "sheet string, y int, line array<boolean>")
    assert sorted((r.x0, r.y0, r.x1, r.y1) for r in regions.regions(lines, ["sheet"]).collect()) == [(0, 0, 1, 1), (0, 2, 2, 4), (2, 0, 3, 1)]
    assert regions.regions(lines.where("false"), ["sheet"]).count() == 0


def test_components_of_graphs(spark):
    rng = np.random.default_rng(2)
    edges = [("chain", k, k + 1) for k in range(200)] + [("hub", 5000, k) for k in range(1, 400)] + [("loops", 3, 3), ("loops", 7, 4), ("loops", 4, 7)]
    edges += [("random", int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for g, a, b in edges:
        r, s = sorted((root((g, a)), root((g, b))))
        parent[s] = r
    df = spark.createDataFrame(edges, "g string, u long, v long").unionByName(spark.createDataFrame([("chain", None, 1)], "g string, u long, v long"))
    got = {(r.g, r.node): (r.g, r.root) for r in components.components(df, ["g"]).collect()}
    assert got == {x: root(x) for x in parent}
