"""Clusters in rounds against the plain loop that defines them."""

import random

import pytest

from assayer.operators import agreement
from assayer.operators.geometry import BOX

SCHEMA = "dataset string, file string, ord long, x0 double, y0 double, x1 double, y1 double"


def iou(a, b):
    wide, high = (max(0.0, min(a[k + 2], b[k + 2]) - max(a[k], b[k])) for k in (0, 1))
    area = lambda c: max(1e-9, (c[2] - c[0]) * (c[3] - c[1]))
    return wide * high / (area(a) + area(b) - wide * high)


def plain(rows, files, least=0.35):
    out = []
    for d in sorted({f[0] for f in files}):
        mine = sorted(r for r in rows if r[0] == d and None not in r[3:])
        everyone = sorted({f for x, f in files if x == d})
        clusters = []
        for _, file, _, *box in mine:
            for c in clusters:
                if iou(box, c[0]) >= least:
                    c[1] += 1
                    c[2].add(file)
                    break
            else:
                clusters.append([box, 1, {file}])
        if len({r[1] for r in mine}) < 2:
            continue
        for box, count, holders in clusters:
            if count >= max(2, int(0.35 * len(everyone))):
                out += [(d, f, *box, count) for f in everyone if f not in holders and not any(iou(r[3:], box) >= least for r in mine if r[1] == f)]
    return sorted(out)


def boxes_at(rng, n, files, places, jitter):
    centres = [(rng.random(), rng.random(), rng.choice([0.02, 0.05, 0.1, 0.3]), rng.choice([0.03, 0.08, 0.2])) for _ in range(places)]
    rows = []
    for _ in range(n):
        x, y, w, h = rng.choice(centres)
        x, y, w, h = (v * (1 + rng.uniform(-jitter, jitter)) for v in (x, y, w, h))
        rows.append((rng.choice("de"), f"f{rng.randrange(files)}", rng.randrange(4), round(x, 3), round(y, 3), round(x + w, 3), round(y + h, 3)))
    return rows


@pytest.mark.parametrize(("seed", "prefix", "jitter", "places"), [(1, 1024, 0.2, 6), (2, 3, 0.2, 5), (4, 1, 0.0, 4)])
def test_against_the_plain_loop(spark, monkeypatch, seed, prefix, jitter, places):
    rng = random.Random(seed)
    rows = boxes_at(rng, 140, 12, places, jitter) + [("e", "f1", 0, None, 0.0, 1.0, 1.0), ("alone", "f1", 0, 0.0, 0.0, 1.0, 1.0), ("alone", "f1", 1, 0.0, 0.0, 1.0, 1.0)]
    files = [(d, f"f{k}") for d in ("d", "e", "alone") for k in range(14)]
    monkeypatch.setattr(agreement, "PREFIX", prefix)
    got = agreement.consensus(spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(files, "dataset string, file string"), ["dataset"]).collect()
    want = plain(rows, files)
    assert sorted(tuple(r) for r in got) == want and want


def test_broadcasts_beyond_their_bound_are_joins(spark, monkeypatch):
    rng = random.Random(9)
    rows, files = boxes_at(rng, 120, 8, 5, 0.2), [(d, f"f{k}") for d in "de" for k in range(9)]
    monkeypatch.setattr(agreement, "BROADCAST_ROWS", 0)
    got = agreement.consensus(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(files, "dataset string, file string"), ["dataset"]).collect()
    assert sorted(tuple(r) for r in got) == plain(rows, files)


def test_reach_covers_all_that_agree():
    rng = random.Random(5)
    for least in (0.2, 0.35, 0.6):
        for _ in range(20_000):
            a = [0.0, 0.0, rng.uniform(0.1, 1), 1.0]
            x, w = rng.uniform(-3, 3), rng.uniform(0.05, 4)
            if iou(a, [x, 0.0, x + w, 1.0]) >= least:
                assert abs(x + w / 2 - a[2] / 2) <= agreement.reach(least) * a[2]


def test_many_boxes_at_a_few_places_take_a_few_rounds(spark, monkeypatch):
    """60,000 boxes of one dataset, no two alike: rounds don't grow with them, and no more than a prefix is in one group's task."""
    from pyspark.sql import functions as F

    place = F.pmod(F.col("id"), F.lit(7)) / 7.0
    jitter = F.rand(3) * 0.01
    rows = spark.range(60_000).select(
        F.lit("d").alias("dataset"), F.concat(F.lit("f"), F.col("id") % 1000).alias("file"), F.col("id").alias("ord"),
        (place + jitter).alias("x0"), (0.1 + F.rand(4) * 0.01).alias("y0"), (place + 0.1 + jitter).alias("x1"), (0.2 + F.rand(5) * 0.01).alias("y1"))
    rounds = []
    plain_spread = agreement.spread
    monkeypatch.setattr(agreement, "spread", lambda f, least: rounds.append(1) or plain_spread(f, least))
    alike, _, _ = agreement.clusters(rows, ["dataset"], ["file", "ord"])
    assert len(rounds) <= 3 and alike.count() == 60_000


def test_given_boxes_join_those_of_their_files(spark):
    box = (0.0, 0.0, 0.5, 0.1)
    rows = [("d", f"f{k}", 0, *box, "mark", c) for k, c in enumerate((0.9, 0.5, None))] + [("d", "f4", 0, 0.7, 0.7, 0.9, 0.9, "mark", 0.3)]
    df = spark.createDataFrame(rows, SCHEMA + ", kind string, confidence double")
    files = spark.createDataFrame([("d", f"f{k}") for k in range(6)], "dataset string, file string")
    got = agreement.with_consensus(df, files, ["dataset"]).where("kind = 'consensus'").collect()
    assert sorted((r.file, r.confidence, *(r[c] for c in BOX)) for r in got) == [(f, 0.9, *box) for f in ("f3", "f4", "f5")]
    assert agreement.with_consensus(df, files, ["dataset"]).count() == 7
    none = df.where("false")
    assert agreement.consensus(none, files, ["dataset"]).count() == 0
