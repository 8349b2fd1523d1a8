"""Orders, distinct lists and small choices that listings are made of. An order is a column `place`, so that it survives joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions import paths as P
from ..sinks.places import checkpointed
from . import spreads


def in_line(rows: DataFrame, order: list[Column], place: str = "place") -> DataFrame:
    """Numbers all rows from 1 in an order, without one task that has them all: rows are sorted by ranges and kept, and a row's
    place is its place in its range after the rows of all ranges before, whose sizes are a table of one row per task."""
    kept = checkpointed(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    split = kept.withColumns({"_range": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = split.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_start"))
    return split.join(F.broadcast(starts), "_range").select(*rows.columns, (F.col("_start") + F.col("_at") + 1).cast("long").alias(place))


def in_line_by(rows: DataFrame, by: list[str], order: list[Column], place: str = "place") -> DataFrame:
    """Numbers the rows of every group from 1. All are sorted by ranges of group and order, so a large group is in many tasks; what a
    range adds to a row's place in it is a row for every group that reaches into the range."""
    kept = checkpointed(rows.orderBy(*by, *order).withColumn("_at", F.monotonically_increasing_id()))
    split = kept.withColumn(spreads.RANGE, F.shiftright("_at", 33))
    sizes = split.groupBy(spreads.RANGE, *by).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy(spreads.RANGE)) - F.col("_n")
    starts = sizes.select(spreads.RANGE, *by, "_first", before.alias("_before"))
    return spreads.joined(split, starts, by).select(*rows.columns, (F.col("_before") + F.col("_at") - F.col("_first") + 1).cast("long").alias(place))


def placed(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Numbers the rows of every group by a window; all rows, if there is nothing to group by, by ranges."""
    if not by:
        return in_line(rows, order)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def media(rows: DataFrame, by: list[str], file: str = "file") -> DataFrame:
    """Media files of each folder with their kind, by lower-cased name."""
    kept = rows.withColumn("kind", X.media_kind(F.col(file))).where("kind IS NOT NULL")
    return placed(kept, by, [F.lower(file), F.col(file)])


def sheet_order(rows: DataFrame, by: list[str], picks_first: bool = False) -> DataFrame:
    """Best score first, unscored as -1, ties as they were; with `picks_first`, picked rows lead."""
    order = [F.desc(F.coalesce("score", F.lit(-1.0))), F.col("pos")]
    return placed(rows, by, [F.desc(F.coalesce("picked", F.lit(False))), *order] if picks_first else order)


def card_order(cards: DataFrame, by: list[str], within_folder: bool = False) -> DataFrame:
    """By lower-cased display name, or slug where it is empty; in the library, by folder first."""
    shown = F.lower(F.coalesce(F.nullif("display_name", F.lit("")), "slug"))
    return placed(cards, by, [*([F.col("subfolder")] if within_folder else []), shown, F.col("slug")])


def folder_order(folders: DataFrame, by: list[str], deepest_first: bool = False) -> DataFrame:
    """To create: the root, then by depth and lower-cased name; to remove: the deepest first."""
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    return placed(folders, by, [F.desc(depth) if deepest_first else depth, F.lower("folder"), F.col("folder")])


def largest(boxes: DataFrame, by: list[str]) -> DataFrame:
    """The largest box of each picture, the first on a tie, and how many there are."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    best = F.max_by(F.struct("id", "x0", "y0", "x1", "y1"), F.struct(area, -F.col("id")))
    return boxes.groupBy(*by).agg(best.alias("_b"), F.count("*").alias("n")).select(*by, "_b.*", "n")


def first_text(texts: Column) -> Column:
    """The first text that isn't empty, else an empty one."""
    return F.coalesce(F.try_element_at(F.filter(texts, lambda t: F.coalesce(t, F.lit("")) != ""), F.lit(1)), F.lit(""))


def vocabulary(*lists: DataFrame, name: str = "folder") -> DataFrame:
    """Every name of the lists once, without empty ones."""
    out = lists[0].select(name)
    for other in lists[1:]:
        out = out.unionByName(other.select(name))
    return out.where(F.coalesce(name, F.lit("")) != "").distinct()


def bag(*found: DataFrame) -> DataFrame:
    """What several detectors find, together; rows that two of them find stay twice."""
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


def upload_ids(rows: DataFrame, by: list[str], raw: str = "raw") -> DataFrame:
    """Identifiers with slashes one way and without suffix, each once, in the order of their first row."""
    clean = F.regexp_replace(F.regexp_replace(P.posix(F.trim(raw)), r"(?i)\.safetensors$", ""), "^/+|/+$", "")
    return rows.withColumn("id", clean).where("id <> ''").groupBy(*by, "id").agg(F.min("ord").alias("ord"))


def grouped_in_order(rows: DataFrame, by: list[str], group: str, order: str) -> DataFrame:
    """Groups with their number of rows, in the order of their first one."""
    counted = rows.groupBy(*by, group).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    return placed(counted, by, [F.col("first_seen"), F.col(group)])


def distinct_methods(methods: DataFrame, by: list[str]) -> DataFrame:
    """Of split methods (method, ord, boxes) with the same boxes the first."""
    w = Window.partitionBy(*by, "boxes").orderBy("ord")
    return methods.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def lookup_one(rows: DataFrame, key: str, value) -> DataFrame:
    """The row of a key; an error without any."""
    found = rows.where(F.col(key) == value)
    missing = rows.sparkSession.range(1).join(found.select(F.lit(1).alias("_f")).limit(1), how="left")
    checked = missing.select(F.when(F.col("_f").isNull(), F.raise_error(F.lit(f"unknown: {value}")).cast("int")).otherwise(1).alias("_ok"))
    return found.join(F.broadcast(checked), F.col("_ok") == 1).drop("_ok")  # one row


def batch_result(rows: DataFrame, by: list[str], error: str = "error") -> DataFrame:
    """Of batches of items with an error or null: done, failed, the first error, and failed_all, which alone fails the batch."""
    bad = F.col(error).isNotNull()
    return rows.groupBy(*by).agg(
        F.count_if(~bad).alias("done"), F.count_if(bad).alias("failed"), F.min_by(error, F.when(bad, F.col("ord"))).alias("first_error"),
        F.bool_and(bad).alias("failed_all"))


def tail(lines: DataFrame, seen: DataFrame, by: list[str]) -> DataFrame:
    """Lines that a reader who has seen `last` lines of each job hasn't got yet."""
    known = seen.select(*by, F.col("last").alias("_last"))
    return lines.join(known, by, "left").where(F.col("line_no") > F.coalesce("_last", F.lit(-1))).drop("_last")
