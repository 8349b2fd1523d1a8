"""Choosing and overlaying: first of equal keys, topmost boxes, recommended items, settings with defaults and secrets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(rows: DataFrame, keys: list[Column], order: str = "ord") -> DataFrame:
    """Of rows with equal keys (paths but for case, sets of boxes) the first by order."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def default_method(methods: DataFrame, by: list[str], count: str = "count", order: str = "ord") -> DataFrame:
    """The first method that finds two or more panels, else the first."""
    w = Window.partitionBy(*by).orderBy(F.desc(F.col(count) >= 2), order)
    return methods.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def hit(points: DataFrame, boxes: DataFrame, by: list[str]) -> DataFrame:
    """The topmost (last) box of its page under every point (by, point, x, y); null without any."""
    p, b = points.alias("p"), boxes.alias("b")
    inside = [F.col(f"p.{c}") == F.col(f"b.{c}") for c in by] + [F.col("x").between(F.col("x0"), F.col("x1")), F.col("y").between(F.col("y0"), F.col("y1"))]
    return p.join(b, inside, "left").groupBy(*(F.col(f"p.{c}").alias(c) for c in by), "point").agg(F.max("ord").alias("hit"))


def recommended(items: DataFrame, picks: DataFrame, keys: list[str]) -> DataFrame:
    """Stills are enabled if they are picked; videos stay as they are."""
    marked = items.join(picks.select(*keys).distinct().withColumn("_p", F.lit(True)), keys, "left")
    picked = F.coalesce("_p", F.lit(False))
    return marked.withColumn("picked", picked).withColumn("enabled", F.when(F.col("kind") == "video", F.col("enabled")).otherwise(F.col("picked"))).drop("_p")


def wanted(rows: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key is among the chosen ones."""
    return rows.join(chosen.select(*keys).distinct(), keys, "left_semi")


def all_selected(rows: DataFrame, by: list[str], selected: str = "selected") -> DataFrame:
    return rows.groupBy(*by).agg(F.bool_and(F.coalesce(selected, F.lit(False))).alias("all_selected"))


def without_skipped(boxes: DataFrame, skipped: DataFrame, sheet: str = "sheet") -> DataFrame:
    """Boxes that the user didn't skip (by ordinal); a sheet of which none is left fails."""
    kept = boxes.join(skipped.select(sheet, "ord"), [sheet, "ord"], "left_anti")
    left = boxes.select(sheet).distinct().join(kept.groupBy(sheet).agg(F.count("*").alias("_n")), sheet, "left")
    empty = F.when(F.col("_n").isNull(), F.raise_error(F.concat(F.lit("no panel left of "), F.col(sheet).cast("string"))).cast("long")).otherwise(F.col("_n"))
    return kept.join(left.select(sheet, empty.alias("panels")), sheet, "right")


def overlaid(defaults: Column, saved: Column) -> Column:
    """A map of defaults under what is saved; unknown keys and nulls of the saved map don't count."""
    known = F.map_filter(saved, lambda k, v: F.array_contains(F.map_keys(defaults), k) & v.isNotNull())
    return F.map_concat(F.map_filter(defaults, lambda k, _: ~F.array_contains(F.map_keys(known), k)), known)


def redacted(config: Column, secrets: tuple[str, ...]) -> Column:
    """Secrets replaced by whether they are set."""
    return F.transform_values(config, lambda k, v: F.when(k.isin(*secrets), F.when(F.coalesce(v, F.lit("")) != "", "set").otherwise("unset")).otherwise(v))


def hub_settings(config: Column, environment: Column, names: tuple[str, ...] = ("HUB_TOKEN",), kinds: tuple[str, ...] = ("dataset", "model")) -> Column:
    """token (the setting's, else the first of the environment's), repo, repo_type, private, and what is missing to be ready."""
    text = lambda m, k: F.nullif(F.trim(F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(""))), F.lit(""))
    token = F.coalesce(text(config, "token"), *(text(environment, n) for n in names))
    repo, private = text(config, "repo"), F.lower(F.coalesce(text(config, "private"), F.lit("true")))
    wanted = [F.when(v.isNull(), F.lit(k)) for k, v in (("token", token), ("repo", repo))]
    return F.struct(
        F.coalesce(token, F.lit("")).alias("token"), F.coalesce(repo, F.lit("")).alias("repo"),
        F.when(text(config, "repo_type").isin(*kinds), text(config, "repo_type")).otherwise(kinds[0]).alias("repo_type"),
        private.isin("1", "true", "yes", "on").alias("private"), F.array_compact(F.array(*wanted)).alias("missing"))


def missing(config: Column, needed: tuple[str, ...]) -> Column:
    """The names of needed settings that are empty, in order; an empty array means ready."""
    return F.array_compact(F.array(*[F.when(F.coalesce(F.try_element_at(config, F.lit(k)), F.lit("")) == "", F.lit(k)) for k in needed]))


def euler(r: Column) -> Column:
    """Rotations about the axes x, y and z, in degrees, of a 3 x 3 matrix as nested arrays."""
    at = lambda i, j: F.element_at(F.element_at(r, i + 1), j + 1)
    level = F.sqrt(at(0, 0) * at(0, 0) + at(1, 0) * at(1, 0))
    return F.struct(
        F.degrees(F.when(level > 1e-6, F.atan2(at(2, 1), at(2, 2))).otherwise(F.atan2(-at(1, 2), at(1, 1)))).alias("x"),
        F.degrees(F.atan2(-at(2, 0), level)).alias("y"),
        F.degrees(F.when(level > 1e-6, F.atan2(at(1, 0), at(0, 0))).otherwise(0.0)).alias("z"))
