"""Sinks: whole-table rewrites of manifests, captions and registries, and plans of files to write.

A write reads nothing that it replaces: results go to a folder of their own, and callers swap folders. Plans are
DataFrames that a driver or an executor carries out; no function here touches files one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(table: DataFrame, updates: DataFrame, keys: list[str], delete: Column | None = None) -> DataFrame:
    """Rows of the table overlaid by updates with the same key: columns that an update leaves null keep their value,
    new keys are added, and rows for which `delete` holds afterwards go (an emptied caption, say)."""
    shared = [c for c in table.columns if c not in keys]
    fresh = updates.select(*keys, *(F.col(c).alias(f"_{c}") for c in shared if c in updates.columns))
    joined = table.withColumn("_old", F.lit(True)).join(fresh.withColumn("_new", F.lit(True)), keys, "full")
    out = joined.select(*keys, *((F.coalesce(f"_{c}", c) if c in updates.columns else F.col(c)).alias(c) for c in shared))
    return out if delete is None else out.where(~F.coalesce(delete, F.lit(False)))


def created(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The table with new rows; a key that is there already fails the write."""
    known = table.select(key).distinct().withColumn("_known", F.lit(True))
    guarded = new.join(known, key, "left")
    taken = F.when(F.col("_known"), F.raise_error(F.concat(F.lit("exists already: "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)
    return table.unionByName(guarded.where(taken).drop("_known"), allowMissingColumns=True)


def removed(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def write_manifests(manifests: DataFrame, path: str) -> None:
    """One JSON object a line, fields in the order of the schema."""
    manifests.write.mode("overwrite").json(path)


def cache_key(path: Column, modified: Column, size: Column, side: int = 720, version: int = 1) -> Column:
    """The key of a materialised preview: another file, time, size or format gives another key."""
    return F.sha1(F.concat_ws("|", path, modified.cast("string"), size.cast("string"), F.lit(str(side)), F.lit(str(version))))


def panel_plan(boxes: DataFrame, sheet: str = "sheet") -> DataFrame:
    """The file that every panel of a sheet is written to: <stem>_<two digits>.png, in reading order."""
    stem = F.regexp_replace(F.col(sheet).cast("string"), r"\.[^.]*$", "")
    return boxes.withColumn("file", F.format_string("%s_%02d.png", stem, F.col("ord")))


def copy_plan(files: DataFrame, folder: Column, name: str = "file") -> DataFrame:
    """source and destination of an import."""
    return files.select(F.col("path").alias("source"), F.concat_ws("/", folder, F.col(name)).alias("destination"))


def crops(patches: DataFrame, px: str = "gray") -> DataFrame:
    """Rows of pixels cut to a kept rectangle (left, top, right, bottom), if it is safe; else as they are."""
    h, w = F.size(px), F.size(F.col(px)[0])
    width, height = F.col("right") - F.col("left"), F.col("bottom") - F.col("top")
    safe = (width >= 32) & (height >= 32) & (width * height >= 0.25 * w * h)
    cut = F.transform(F.slice(px, F.col("top") + 1, height), lambda row: F.slice(row, F.col("left") + 1, width))
    return patches.withColumn("applied", safe).withColumn(px, F.when(safe, cut).otherwise(F.col(px)))


def next_free_version(wanted: DataFrame, taken: DataFrame, key: str = "stem") -> DataFrame:
    """The smallest version from 1 that no taken row (key, version) has."""
    w = Window.partitionBy(key).orderBy("version")
    firsts = taken.select(key, "version").distinct().where("version > 0").withColumn("_n", F.row_number().over(w))
    run = firsts.where("version = _n").groupBy(key).agg(F.max("version").alias("_top"))
    return wanted.join(run, key, "left").withColumn("version", F.coalesce(F.col("_top") + 1, F.lit(1))).drop("_top")


def report_line() -> Column:
    """Score, reason and file, as a command line shows them."""
    return F.format_string("%6.1f  %-14s %s", F.coalesce("score", F.lit(0.0)), "reason", "name")


def report(rows: DataFrame, path: str) -> None:
    rows.select(report_line().alias("value")).write.mode("overwrite").text(path)


def filled_in(lite: DataFrame, full: DataFrame, keys: list[str]) -> DataFrame:
    """A quick listing with the details of the rows whose full read has come; null for the others."""
    return lite.join(full, keys, "left")


def save_manifests(manifests: DataFrame, path: str) -> DataFrame:
    """Writes normalised manifests to a folder of their own and gives them as they are read back."""
    write_manifests(manifests, path)
    return manifests.sparkSession.read.schema(manifests.schema).json(path)


def recorded(datasets: DataFrame, results: DataFrame) -> DataFrame:
    """Datasets with the result (output, at) and the content hash of an extraction that has just ended."""
    new = results.select("slug", *(F.col(c).alias(f"_{c}") for c in ("output", "at", "hash")))
    joined = datasets.join(new, "slug", "left")
    last = F.when(F.col("_output").isNotNull(), F.struct(F.col("_output").alias("output"), F.col("_at").alias("at"), F.col("_hash").alias("content_hash")))
    return joined.select(*(c for c in datasets.columns if c != "last_extract"), F.coalesce(last, "last_extract").alias("last_extract"))


def undone(items: DataFrame, originals: DataFrame, keys: list[str]) -> DataFrame:
    """Cleaned items that have an original get its pixels back and are flagged again; the others stay."""
    kept = originals.select(*keys, F.col("gray").alias("_gray"))
    back = F.col("_gray").isNotNull() & (F.col("clean") == "cleaned")
    joined = items.join(kept, keys, "left")
    return joined.select(*(F.when(back, "flagged").otherwise(F.col("clean")).alias("clean") if c == "clean" else
                           F.when(back, F.col("_gray")).otherwise(F.col("gray")).alias("gray") if c == "gray" else F.col(c) for c in items.columns), back.alias("restored"))
