"""Quality of stills: scores from measurements, crowded bins, advice, and a diverse pick."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions import thresholds as T
from ..sinks.places import checkpointed
from . import listing, spreads

MEASURES = ("variance", "eyes", "box_side", "image_side", "mean", "clipped", "split", "yaw", "pitch", "face_share", "eyes_share")


def scored(features: DataFrame) -> DataFrame:
    """Adds the terms, score (rounded to one place), reason, scale, pose_bin and band to rows with MEASURES.

    Where `eye_variance` is measured too, eyes that are far softer than the face lower the variance.
    """
    c = {m: F.col(m) for m in MEASURES}
    if "eye_variance" in features.columns:
        c["variance"] = X.softened(c["variance"], F.col("eye_variance"))
    out = features.withColumns({
        "s_sharp": X.sharpness(c["variance"]), "s_face": X.face_size(c["eyes"], c["box_side"], c["image_side"]),
        "s_light": X.light(c["mean"], c["clipped"], c["split"]), "s_pose": X.pose_score(c["yaw"], c["pitch"]),
        "scale": X.scale_bin(c["face_share"], c["eyes_share"]), "pose_bin": X.pose_bin(c["yaw"]),
    }).withColumn("raw", 100 * F.col("s_sharp") * F.col("s_face") * F.col("s_light") * F.col("s_pose"))
    why = X.reason(*(F.col(k) for k in ("raw", "s_sharp", "s_face", "s_light", "s_pose", "mean", "clipped", "split")))
    out = out.withColumns({"score": F.bround("raw", 1), "reason": why}).withColumn("band", X.band(F.col("score")))
    return out.drop("raw")


def ranked(rows: DataFrame, by: list[str], name: str = "name") -> DataFrame:
    """Rank within groups: score descending, null last, then lower-cased name.

    Most rows may share a score (0 where a still failed, none where there is none), and a group may have most of the rows, so all
    are sorted by ranges of the whole order.
    """
    return listing.in_line_by(rows, by, [F.desc(F.coalesce("score", F.lit(-1.0))), F.lower(name), F.col(name)], "rank")


#: What a score's details are unless they were measured.
DEBUG = {"s_sharp": 0.0, "s_face": 0.0, "s_light": 0.0, "s_pose": 0.0, "mean": 0.0, "clipped": 0.0, "split": 0.0, "yaw": 0.0, "pitch": 0.0, "scale": "", "pose_bin": "unknown"}


def with_debug(rows: DataFrame) -> DataFrame:
    """Adds `debug`, a struct of the score's details with a default for each that is missing or null; a null score becomes 0."""
    detail = [(F.coalesce(F.col(c), F.lit(d)) if c in rows.columns else F.lit(d)).alias(c) for c, d in DEBUG.items()]
    return rows.withColumn("debug", F.struct(*detail)).withColumn("score", F.bround(F.coalesce("score", F.lit(0.0)), 1))


def scan_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows by band, flagged ones, and those that are cleaned or have an original, in one pass."""
    band = X.band(F.col("score"))
    return rows.groupBy(*by).agg(
        F.count("*").alias("total"), *(F.count_if(band == b).alias(b) for b in ("hi", "mid", "lo")), F.count_if(F.col("reason") != "ok").alias("flagged"),
        F.count_if(F.coalesce(F.col("clean") == "cleaned", F.lit(False)) | F.coalesce("has_original", F.lit(False))).alias("cleaned"))


def crowding(rows: DataFrame, by: list[str]) -> DataFrame:
    """Bins (scale, pose_bin) that hold too much of a group's usable rows."""
    bins = rows.where("score > 0").groupBy(*by, F.coalesce("scale", F.lit("closeup")).alias("scale"), F.coalesce("pose_bin", F.lit("unknown")).alias("pose_bin")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by))
    out = bins.withColumn("total", total).withColumn("share", F.col("n") / F.col("total"))
    return out.where((F.col("total") >= T.CROWD_LEAST) & (F.col("n") >= T.CROWD_COUNT) & (F.col("share") >= T.CROWD_SHARE))


def histograms(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts by scale, by pose and by both, in one pass."""
    b = [F.col(c) for c in by]
    sets = [[*b, F.col("scale")], [*b, F.col("pose_bin")], [*b, F.col("scale"), F.col("pose_bin")]]
    return rows.groupingSets(sets, *b, F.col("scale"), F.col("pose_bin")).agg(F.count("*").alias("n"))


def best_per_bin(rows: DataFrame, by: list[str], name: str = "name") -> DataFrame:
    w = Window.partitionBy(*by, "pose_bin").orderBy(F.desc_nulls_last("score"), F.lower(name), name)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def advise(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, level, id of what would improve each group, most urgent first (`place`), ten at most.

    One aggregate a group, then a closed list of rules; crowded bins are rules that the data give.
    """
    still = F.coalesce(F.col("reason") != "not_image", F.lit(True))
    faced = still & (F.col("score") > 0)
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    close = lambda p: count(faced & (F.col("scale") == "closeup") & (F.col("pose_bin") == p))
    sums = {
        "images": count(still), "no_face": count(still & (F.col("reason") == "no_face")), "faced": count(faced),
        "usable": count(faced & (F.col("score") >= T.USABLE)),
        "soft": count(faced & ((F.col("reason") == "blurry") | (F.col("s_sharp") < 0.3))),
        "badly_lit": count(faced & F.col("reason").isin("dark", "blown", "split_light")),
        "tiny": count(faced & ((F.col("reason") == "face_too_small") | (F.col("scale") == "full"))),
        **{s: count(faced & (F.col("scale") == s)) for s in T.QUOTAS}, **{p: close(p) for p in T.POSES},
    }
    per = rows.groupBy(*by).agg(*(v.alias(k) for k, v in sums.items()))
    n = F.greatest(F.lit(1), F.col("faced"))
    many = lambda c: (F.col(c) >= 3) | (F.col(c) / n >= 0.4)
    judged = (F.col("images") > 0) & ~((F.col("no_face") > 0) & (F.col("faced") == 0))
    rules: list[tuple[str, str, int, Column]] = [
        ("need", "empty", 0, F.col("images") == 0),
        ("need", "no_face", 1, (F.col("images") > 0) & (F.col("no_face") > 0) & (F.col("faced") == 0)),
        ("need", "count", 2, judged & (F.col("usable") < T.USABLE)),
        *(("need", f"cu_{p}", 3 + k, judged & (F.col(p) == 0)) for k, p in enumerate(T.NEEDED)),
        *(("improve", f"cu_{p}", 6 + k, judged & (F.col(p) == 0)) for k, p in enumerate(T.NICE)),
        ("need", "medium", 8, judged & (F.col("medium") < 1)), ("improve", "medium2", 8, judged & (F.col("medium") == 1)),
        ("improve", "full", 9, judged & (F.col("full") < 1)), ("need", "sharp", 2000, judged & many("soft")),
        ("improve", "light", 2001, judged & many("badly_lit")),
        ("need", "tighter", 2002, judged & (F.col("closeup") < 5) & (F.col("tiny") > 0)),
    ]
    tips = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(v).alias("level"), F.lit(i).alias("id"), F.lit(o).alias("ord"))) for v, i, o, c in rules]))
    said = per.select(*by, F.explode(tips).alias("tip")).select(*by, "tip.*")
    order = Window.partitionBy(*by).orderBy(F.desc("n"), "scale", "pose_bin")
    crowded = crowding(rows, by).join(per.where(judged).select(*by), by, "left_semi").select(
        *by, F.when(F.col("share") >= 0.4, "need").otherwise("improve").alias("level"),
        F.concat_ws("_", F.lit("crowd"), "scale", "pose_bin").alias("id"), (F.lit(1000) + F.row_number().over(order)).alias("ord"))
    every = said.unionByName(crowded)
    fine = per.join(every.select(*by).distinct(), by, "left_anti").select(*by, F.lit("ok").alias("level"), F.lit("balanced").alias("id"), F.lit(0).alias("ord"))
    urgency = F.when(F.col("level") == "need", 0).when(F.col("level") == "improve", 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(urgency, "ord")).cast("long")
    return every.unionByName(fine).withColumn("place", place).where("place <= 10").drop("ord")


#: Most that diversity can add to a score, what a degree of distance adds, and how much a tilt counts beside a turn.
FARTHEST, A_DEGREE, TILT = 25.0, 1 / 3, 0.6
#: Sides in degrees of the cells of poses, finest first, and steps of scores within which rows aren't told apart.
SIDES, STEP = (1.0, 4.0, 16.0), 0.1


def greedy(pool: pd.DataFrame, n: int, quotas: dict[str, int]) -> list[int]:
    """Places of the pick in a pool that is sorted by rank: one close-up a pose, the quotas, then the rest, each time the
    row with the most of score, distance of its pose to those picked, and novelty of its scale."""
    if len(pool) <= n:
        return list(range(len(pool)))
    score, yaw, pitch = (pool[c].fillna(0).to_numpy(float) for c in ("score", "yaw", "pitch"))
    scale, pose = (pool[c].fillna("").to_numpy(object) for c in ("scale", "pose_bin"))
    out: list[int] = []
    near, alike, free = np.full(len(pool), np.inf), np.zeros(len(pool)), np.ones(len(pool), bool)

    def take(k: int) -> None:
        out.append(k)
        free[k] = False
        np.minimum(near, np.hypot(yaw - yaw[k], TILT * (pitch - pitch[k])), out=near)
        alike[scale == scale[k]] += 1

    for p in T.POSES:
        first = np.flatnonzero((scale == "closeup") & (pose == p))
        if len(first) and len(out) < n:
            take(int(first[0]))
    steps = [s for s, quota in quotas.items() for _ in range(max(0, quota - sum(scale[k] == s for k in out)))]
    for s in [*steps, *[None] * n]:
        left = np.flatnonzero(free if s is None else free & (scale == s))
        if len(left) and len(out) < n:
            gain = score[left] + (10 * np.minimum(near[left] / 30, FARTHEST / 10) - 3 * alike[left] if out else 0)
            take(int(left[gain.argmax()]))
    return out


def can_be_picked(rows: DataFrame, by: list[str], name: str, n: int) -> DataFrame:
    """The rows that a pick of n may hold.

    Two rows of one scale whose poses lie in one cell differ by at most a cell's diameter in what diversity adds, so one whose
    score leads by more is ahead as long as it isn't picked. A row therefore can't be picked
    - if n + 1 rows of its scale and cell lead by that much (for all poses together: by all that distance may add), or
    - if one does, and n + 1 rows of its scale lead by that much wherever they are: once the one is picked, the row is too close
      to it to gain more than that, and one of the n + 1 is still free.
    What leads is judged by counts per scale, cell and step of score, from the finest cells to the widest, so no task has the rows
    of a group, and no row is joined to others. Close-ups of the best step of their pose stay too, as the pick begins with them.
    """
    u, v = (F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)) for x in (F.col("yaw").cast("double"), TILT * F.col("pitch").cast("double")))
    cell = {"_scale": F.coalesce("scale", F.lit("")), "_u": F.floor(u / SIDES[0]), "_v": F.floor(v / SIDES[0]), "_step": F.floor(F.col("score") / STEP)}
    placed = rows.withColumns(cell)
    keys = [*by, *cell, "pose_bin"]
    counts = checkpointed(placed.groupBy(*keys).agg(F.count("*").alias("_n")))
    lead = lambda *keys: F.sum("_n").over(Window.partitionBy(*by, "_scale", *keys).orderBy(F.desc("_step")))
    of_scale = counts.groupBy(*by, "_scale", "_step").agg(F.sum("_n").alias("_n")).withColumn("_lead", lead())
    enough = of_scale.where(F.col("_lead") >= n + 1).groupBy(*by, "_scale").agg(F.max("_step").alias("_best"))
    closeup = F.when(F.col("_scale") == "closeup", F.col("_step"))
    first = F.coalesce(closeup == F.max(closeup).over(Window.partitionBy(*by, "pose_bin", "_scale")), F.lit(False))
    left = spreads.matched(counts, enough, [*by, "_scale"], "left").withColumn("_first", first)
    behind = lambda step, reach: F.coalesce(F.col(step) - reach / STEP >= F.col("_step") + 1, F.lit(False))
    left = left.where(F.col("_first") | ~behind("_best", FARTHEST + 1e-6))
    for side in SIDES:
        reach = side * 2**0.5 * A_DEGREE + 1e-6
        wide = [F.floor(F.col(c) * SIDES[0] / side) for c in ("_u", "_v")]
        whole = Window.partitionBy(*by, "_scale", *wide)
        many = F.max(F.when(F.col("_lead") >= n + 1, F.col("_step"))).over(whole)
        told = left.withColumn("_lead", lead(*wide)).withColumns({"_many": many, "_top": F.max("_step").over(whole)})
        left = told.where(F.col("_first") | ~(behind("_many", reach) | (behind("_top", reach) & behind("_best", reach)))).select(*left.columns)
    return spreads.matched(placed, left.select(*keys), keys, "left_semi").select(*rows.columns)


def pick_diverse(rows: DataFrame, by: list[str], name: str = "name", n: int = T.PICKS) -> DataFrame:
    """by, name, place of the pick of every group. Rows that can't be picked go first, in Spark; what is left of a group, a
    curator's set, fits a task, and its order is part of the result."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pool = pdf.assign(_l=pdf[name].str.lower()).sort_values(["score", "_l", name], ascending=[False, True, True])
        pool = pool.reset_index(drop=True)
        chosen = pool.iloc[greedy(pool, n, T.QUOTAS)]
        return chosen[[*by, name]].assign(place=range(1, len(chosen) + 1))

    kinds = dict(rows.dtypes)
    ddl = ", ".join(f"{c} {kinds[c]}" for c in [*by, name]) + ", place long"
    best = Window.partitionBy(*by, name).orderBy(F.desc("score"), F.lower(name))
    once = rows.select(*by, name, "score", "yaw", "pitch", "scale", "pose_bin").where("score > 0").withColumn("_o", F.row_number().over(best)).where("_o = 1").drop("_o")
    return can_be_picked(once, by, name, n).groupBy(*by).applyInPandas(run, ddl)
