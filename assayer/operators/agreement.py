"""Consensus of boxes: clusters by their first box, in rounds, for groups of any size.

In order, a box joins the first cluster whose first box it overlaps, else it founds one. So a box is a first one if and only if it
overlaps no first one before it, and whether it is depends on boxes before it alone. Hence rounds: of the boxes of a group that
are undecided the earliest few are decided among themselves, in order, and what the new first ones overlap is decided too. As a
prefix of boxes covers most places that later boxes are at, a few rounds decide a group of any size; no pairs of all boxes are made.

First ones meet boxes by cells: overlapping boxes have centres that are less than a box apart, so a first one is put into the
cells where such centres can lie, and a box looks into the cell of its centre only. Boxes are neither exploded nor shuffled for it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions import thresholds as T
from ..sinks.places import checkpointed
from .geometry import BOX

#: Boxes of a group that a round decides among themselves, first ones that are broadcast at most, and the side of a cell.
PREFIX, BROADCAST_ROWS, CELL = 1024, 100_000, 0.125
#: Parts of a group that find their earliest boxes by themselves, before those of the group are taken.
PARTS = 32


def reach(least: float) -> float:
    """How far the centres of two boxes can be apart in units of one's side, if they agree by `least` or more: the other's side is
    1 / least times as long at most, and `least` of it is shared."""
    return 0.5 + 0.5 / least - 1.0 + 1e-9


def iou(box: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The measure of `expressions.iou`, of one box with each of the others."""
    side = np.maximum(0.0, np.minimum(box[2:], others[:, 2:]) - np.maximum(box[:2], others[:, :2]))
    both = side[:, 0] * side[:, 1]
    area = lambda x: np.maximum(1e-9, (x[..., 2] - x[..., 0]) * (x[..., 3] - x[..., 1]))
    return both / (area(box) + area(others) - both)


def first_ones(boxes: np.ndarray, least: float) -> list[int]:
    """Places of the boxes, in order, that overlap no first one before them."""
    firsts, found = np.empty_like(boxes), []
    for k, box in enumerate(boxes):
        if not (iou(box, firsts[: len(found)]) >= least).any():
            firsts[len(found)] = box
            found.append(k)
    return found


def cell(column: Column) -> Column:
    return F.floor(column / CELL).cast("int")


def centred(boxes: DataFrame) -> DataFrame:
    """With the cell of each box's centre."""
    return boxes.withColumns({"_cx": cell((F.col("x0") + F.col("x1")) / 2), "_cy": cell((F.col("y0") + F.col("y1")) / 2)})


def spread(firsts: DataFrame, least: float) -> DataFrame:
    """First ones once for each cell in which the centre of a box can lie that agrees with them."""
    far = reach(least)

    def cells(lo: str, hi: str) -> Column:
        centre, side = (F.col(lo) + F.col(hi)) / 2, F.col(hi) - F.col(lo)
        return F.sequence(cell(centre - far * side), cell(centre + far * side))

    return firsts.withColumn("_cx", F.explode(cells("x0", "x1"))).withColumn("_cy", F.explode(cells("y0", "y1")))


def met(boxes: DataFrame, firsts: DataFrame, by: list[str], least: float, how: str, rows: int) -> DataFrame:
    """Boxes (with cells) and the first ones that they agree with; `rows` is the number of first ones, put into cells."""
    b, f = boxes.alias("b"), (F.broadcast(firsts) if rows <= BROADCAST_ROWS else firsts).alias("f")
    same = [F.col(f"b.{c}").eqNullSafe(F.col(f"f.{c}")) for c in by] + [F.col(f"b.{c}") == F.col(f"f.{c}") for c in ("_cx", "_cy")]
    box = lambda t: {c: F.col(f"{t}.{c}") for c in BOX}
    agree = X.iou(F.struct(*(v.alias(c) for c, v in box("b").items())), F.struct(*(v.alias(c) for c, v in box("f").items()))) >= least
    return b.join(f, [*same, agree], how)


def clusters(boxes: DataFrame, by: list[str], order: list[str], least: float = T.SAME_BOX) -> tuple[DataFrame, DataFrame, int]:
    """The distinct boxes of every group with their number `n`, the first of them in `order` as `first`, and their cells; then
    the first ones among them, and how many cells these are in.

    Equal boxes are decided alike: what a later one overlaps an earlier one does. So only distinct boxes take part.
    """
    keys, kind = [*by, *BOX], dict(boxes.dtypes)
    alike = boxes.groupBy(*keys).agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("n"))
    alike = checkpointed(centred(alike))
    undecided, found = alike, None
    shape = ", ".join(f"{c} {kind[c]}" for c in by) + ", " + ", ".join(f"{c} double" for c in BOX) + f", first {dict(alike.dtypes)['first']}"

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_place")
        return pdf.iloc[first_ones(pdf[list(BOX)].to_numpy(float), least)][[*by, *BOX, "first"]]

    while True:
        part = F.pmod(F.xxhash64(*BOX), F.lit(PARTS))
        near = Window.partitionBy(*by, "_part").orderBy("first", *BOX)
        whole = Window.partitionBy(*by).orderBy("first", *BOX)
        earliest = undecided.withColumn("_part", part).withColumn("_near", F.row_number().over(near)).where(F.col("_near") <= PREFIX)
        earliest = earliest.withColumn("_place", F.row_number().over(whole)).where(F.col("_place") <= PREFIX)
        new = checkpointed(earliest.select(*by, *BOX, "first", "_place").groupBy(*by).applyInPandas(decide, shape))
        if new.isEmpty():
            break
        found = new if found is None else found.unionByName(new)
        placed = checkpointed(spread(new, least))
        undecided = checkpointed(met(undecided, placed, by, least, "left_anti", placed.count()))
    firsts = alike.select(*by, *BOX, "first").where("false") if found is None else found
    placed = checkpointed(spread(firsts, least))
    return alike, placed, placed.count()


def consensus(boxes: DataFrame, files: DataFrame, by: list[str], least: float = T.SAME_BOX) -> DataFrame:
    """(by, file, x0..y1, count): boxes that files lack though enough others have them.

    Boxes (by, file, ord, x0..y1) join clusters in the order of file, ord and place. A cluster of max(2, floor(0.35 * files))
    boxes is given to every file of the group that has no box in it and none that overlaps its first one. Groups of which fewer
    than two files have boxes give nothing; null coordinates agree with nothing; empty tables give an empty result.
    """
    rows = boxes.select(*by, "file", "ord", *BOX).where(" AND ".join(f"{c} IS NOT NULL" for c in BOX))
    alike, firsts, cells = clusters(rows, by, ["file", "ord"], least)
    own = met(alike, firsts, by, least, "inner", cells)
    members = own.groupBy(*(F.col(f"b.{c}").alias(c) for c in [*by, *BOX])).agg(F.min(F.struct("f.first", *(f"f.{c}" for c in BOX))).alias("mine"), F.first("b.n").alias("n"))
    counted = members.groupBy(*by, "mine").agg(F.sum("n").alias("count"))
    sizes = files.select(*by, "file").distinct().groupBy(*by).agg(F.count("*").alias("_files"))
    flagged = rows.select(*by, "file").distinct().groupBy(*by).agg(F.count("*").alias("_flagged"))
    enough = F.col("count") >= F.greatest(F.lit(T.CONSENSUS_LEAST), F.floor(F.lit(T.CONSENSUS_SHARE) * F.col("_files")))
    large = counted.join(sizes, by).join(flagged, by).where(enough & (F.col("_flagged") > 1)).select(*by, "mine.first", *(f"mine.{c}" for c in BOX), "count")
    large = checkpointed(large)
    placed = checkpointed(spread(large, least))
    has = met(centred(rows), placed, by, least, "inner", placed.count())
    has = has.select(*(F.col(f"b.{c}").alias(c) for c in by), F.col("b.file").alias("file"), *(F.col(f"f.{c}").alias(c) for c in BOX)).distinct()
    given = files.select(*by, "file").distinct().join(large, by)
    return given.join(has, [*by, "file", *BOX], "left_anti").select(*by, "file", *BOX, "count")


def with_consensus(boxes: DataFrame, files: DataFrame, by: list[str]) -> DataFrame:
    """All boxes, and those that files are given: of kind "consensus" and at least 0.8 confident, as sure as their first box if that
    is surer. Columns (by, file, ord, x0..y1, kind, confidence); a given box comes after its file's own ones."""
    keep = [*by, "file", "ord", *BOX, "kind", "confidence"]
    given = consensus(boxes, files, by)
    sure = boxes.groupBy(*by, *BOX).agg(F.min_by("confidence", F.struct("file", "ord")).alias("confidence"))
    added = given.join(sure, [*by, *BOX], "left").select(
        *by, "file", F.lit(None).cast(dict(boxes.dtypes)["ord"]).alias("ord"), *BOX, F.lit("consensus").alias("kind"),
        F.greatest(F.lit(0.8), F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(0.6))).alias("confidence"))
    return boxes.select(*keep).unionByName(added)
