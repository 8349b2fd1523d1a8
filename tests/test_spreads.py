"""Quantiles of hot groups, orders of large groups and digests as a tree, against plain Python."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.operators import catalog, geometry, listing, spreads

KINDS = "g string, h long, v double, w double"


def drawn(n: int, seed: int = 4) -> list[tuple]:
    """Two thirds of the rows in one group, half of its values equal, nulls in every column."""
    rng = random.Random(seed)
    pick = lambda x, p: None if rng.random() < p else x
    return [(pick("hot" if rng.random() < 0.7 else f"g{k % 7}", 0.05), pick(k % 2, 0.1), pick(rng.choice([1.0, rng.gauss(0, 1e6), rng.random()]), 0.1), pick(float(k % 9), 0.2)) for k in range(n)]


@pytest.mark.parametrize("n", [0, 1, 2, 2000])
def test_quantiles(spark, n):
    rows = drawn(n) + ([("none", 1, None, None)] if n else [])
    df = spark.createDataFrame(rows, KINDS).repartition(5)
    shares = {"low": 0.0, "median": 0.5, "p90": 0.9, "top": 1.0}
    got = {(r.g, r.h): r for r in spreads.quantiles(df, ["g", "h"], {"v": F.col("v"), "w": F.col("w")}, shares).collect()}
    assert set(got) == {r[:2] for r in rows}
    for key, r in got.items():
        for k, c in ((2, "v"), (3, "w")):
            values = [x[k] for x in rows if x[:2] == key and x[k] is not None]
            assert r[f"{c}_n"] == len(values)
            want = [float(np.quantile(values, q)) if values else None for q in shares.values()]
            assert [r[f"{c}_{s}"] for s in shares] == pytest.approx(want) if values else [r[f"{c}_{s}"] for s in shares] == want


def test_spread(spark):
    df = spark.createDataFrame(drawn(800), KINDS)
    r = spreads.spread(df, ["g"], F.col("v")).where("g = 'hot'").first()
    v = [x[2] for x in drawn(800) if x[0] == "hot" and x[2] is not None]
    assert (r.n, r.top) == (len(v), max(v))
    assert (r["median"], r.p90, r.deviation) == pytest.approx((np.median(v), np.quantile(v, 0.9), np.std(v)))


def test_no_task_has_a_group(spark):
    """The distinct values of a group that has all rows lie in many ranges, and so do rows that are numbered."""
    df = spark.range(0, 40000, 1, 8).select(F.lit("g").alias("g"), F.rand(1).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a few thousand rows would share a task
    try:
        held = spreads.ranged(df, ["g", "v"]).groupBy(spreads.RANGE).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(held) >= 3 and max(r["count"] for r in held) < 20000
    plan = spreads.quantiles(df, ["g"], {"v": F.col("v")}, {"median": 0.5})._jdf.queryExecution().toString()
    assert "Percentile" not in plan and "collect_list" not in plan and "percentile" not in plan


def test_slivers_of_a_large_group(spark):
    rng = random.Random(2)
    rows = [("p" if k % 3 else None, k, *(x := (rng.random(), rng.random())), x[0] + rng.choice([0.01, 0.2, rng.random()]), x[1] + rng.random()) for k in range(600)] + [("thin", 900, 0.0, 0.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "page string, id long, x0 double, y0 double, x1 double, y1 double").withColumn("_good_name", F.lit(1))
    got = geometry.without_slivers(df, ["page"])
    assert got.columns == df.columns
    want = set()
    for page in ("p", None, "thin"):
        mine = [(r[1], r[4] - r[2], r[5] - r[3]) for r in rows if r[0] == page]
        w, h, a = (0.35 * float(np.median(x)) for x in ([m[1] for m in mine], [m[2] for m in mine], [m[1] * m[2] for m in mine]))
        good = {m[0] for m in mine if m[1] >= w and m[2] >= h and m[1] * m[2] >= a}
        want |= good or {m[0] for m in mine}
    assert {r.id for r in got.collect()} == want


def test_places_in_groups(spark):
    rows = drawn(900)
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id long, " + KINDS).repartition(7)
    got = {r.id: r.place for r in listing.in_line_by(df, ["g"], [F.col("id").desc()]).collect()}
    for g in {r[0] for r in rows}:
        ids = sorted((k for k, r in enumerate(rows) if r[0] == g), reverse=True)
        assert [got[k] for k in ids] == list(range(1, len(ids) + 1))
    assert listing.in_line_by(df.limit(0), ["g"], [F.col("id")]).count() == 0


def tree(texts: list[str], width: int, levels: int) -> str:
    for _ in range(levels):
        texts = [hashlib.sha256(";".join(texts[k : k + width]).encode()).hexdigest() for k in range(0, len(texts), width)]
    return hashlib.sha256(("v1;" + ";".join(texts)).encode()).hexdigest()


def test_hash_tree(spark):
    rng = random.Random(9)
    rows = [("s" if k < 500 else f"t{k % 3}", k * 3 % 1000, rng.random() < 0.8, rng.random() < 0.9 or None, f"f{k}é", None if k % 50 == 0 else str(k)) for k in range(600)] + [("off", 1, False, True, "a", "1"), (None, 1, True, True, "a", "1")]
    df = spark.createDataFrame(rows, "slug string, pos long, enabled boolean, present boolean, file string, size string")
    got = {r.slug: (r.hash, r.enabled_files) for r in catalog.content_hash(df, F.lit("v1"), width=4, levels=3).collect()}
    assert set(got) == {r[0] for r in rows}
    for slug in got:
        mine = sorted(((r[1], ",".join(x for x in r[4:] if x is not None)) for r in rows if r[0] == slug and r[2] and r[3]))
        assert got[slug] == (tree([t for _, t in mine], 4, 3), len(mine))
    one = catalog.content_hash(df.where("slug = 's'"), F.lit("v1"), width=4, levels=3).first().hash
    assert one != catalog.content_hash(df.where("slug = 's'").withColumn("size", F.concat("size", F.when(F.col("file") == "f17é", "0").otherwise(""))), F.lit("v1"), width=4, levels=3).first().hash
