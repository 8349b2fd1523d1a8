"""Geometry: runs, gaps and spans of masks; boxes that overlap, merge and agree; reading order; recursive splits."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions import thresholds as T
from . import spreads

BOX = ("x0", "y0", "x1", "y1")


def runs(marks: DataFrame, by: list[str], at: str = "at", mask: str = "mask", least: int = 1) -> DataFrame:
    """(by, start, end): stretches of consecutive places whose mask holds, ends included."""
    w = Window.partitionBy(*by).orderBy(at)
    islands = marks.where(mask).withColumn("_g", F.col(at) - F.row_number().over(w))
    out = islands.groupBy(*by, "_g").agg(F.min(at).alias("start"), F.max(at).alias("end")).drop("_g")
    return out.where(F.col("end") - F.col("start") + 1 >= least)


def merged(found: DataFrame, by: list[str], gap: int = 2, least: int = 1) -> DataFrame:
    """Runs at most `gap` places apart become one."""
    w = Window.partitionBy(*by).orderBy("start")
    new = F.coalesce((F.col("start") - F.lag("end").over(w) - 1 > gap).cast("int"), F.lit(1))
    groups = found.withColumn("_new", new).withColumn("_g", F.sum("_new").over(w))
    return groups.groupBy(*by, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_g").where(F.col("end") - F.col("start") + 1 >= least)


def spans(found: DataFrame, lengths: DataFrame, by: list[str], least: int = 1) -> DataFrame:
    """(by, start, end): what is between runs, ends excluded; `lengths` has (by, length)."""
    border = lengths.select(*by, F.col("length").alias("start"), F.col("length").alias("end"))
    w = Window.partitionBy(*by).orderBy("start", "end")
    out = found.select(*by, "start", "end").unionByName(border).withColumn("_from", F.coalesce(F.lag("end").over(w) + 1, F.lit(0)))
    return out.select(*by, F.col("_from").alias("start"), F.col("start").alias("end")).where(F.col("end") - F.col("start") >= least)


def overlapping(boxes: DataFrame, by: list[str], least: float = T.SAME_BOX, cell: float = 0.25) -> DataFrame:
    """Pairs (by, a, b, iou) of boxes (by, id, x0..y1) that agree.

    Candidates come from a join on the cells of a grid that boxes touch, so only boxes near each other meet; a pair
    is taken in the first cell that both touch.
    """
    cells = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    gridded = boxes.select(*by, "id", F.struct(*BOX).alias("box"), F.explode(cells("x0", "x1")).alias("cx"), cells("y0", "y1").alias("_cys"))
    gridded = gridded.withColumn("cy", F.explode("_cys")).drop("_cys")
    p, q = gridded.alias("p"), gridded.alias("q")
    same = [F.col(f"p.{c}") == F.col(f"q.{c}") for c in [*by, "cx", "cy"]]
    first = (F.col("p.cx") == F.greatest(F.floor(F.col("p.box.x0") / cell), F.floor(F.col("q.box.x0") / cell))) & (
        F.col("p.cy") == F.greatest(F.floor(F.col("p.box.y0") / cell), F.floor(F.col("q.box.y0") / cell)))
    met = p.join(q, [*same, F.col("p.id") < F.col("q.id"), first])
    return met.select(*(F.col(f"p.{c}") for c in by), F.col("p.id").alias("a"), F.col("q.id").alias("b"), X.iou(F.col("p.box"), F.col("q.box")).alias("iou")).where(F.col("iou") >= least)


def kept_rectangle(boxes: DataFrame, by: list[str]) -> DataFrame:
    """What strips at the edges leave of the unit square, rounded to 5 places; the whole square if they leave too little."""
    at = lambda e, c: F.when(F.col("edge") == e, F.col(c))
    cut = boxes.groupBy(*by).agg(
        F.greatest(F.lit(0.0), F.max(at("left", "x1"))).alias("x0"), F.greatest(F.lit(0.0), F.max(at("top", "y1"))).alias("y0"),
        F.least(F.lit(1.0), F.min(at("right", "x0"))).alias("x1"), F.least(F.lit(1.0), F.min(at("bottom", "y0"))).alias("y1"))
    small = (F.col("x1") - F.col("x0") < 0.05) | (F.col("y1") - F.col("y0") < 0.05)
    full = {"x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0}
    return cut.withColumn("_small", small).withColumns({c: F.when(F.col("_small"), v).otherwise(F.bround(c, 5)) for c, v in full.items()}).drop("_small")


def strips(boxes: DataFrame, by: list[str]) -> DataFrame:
    """The union of the boxes of every edge."""
    return boxes.groupBy(*by, "edge").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def without_slivers(boxes: DataFrame, by: list[str], share: float = 0.35) -> DataFrame:
    """Boxes whose width, height and area reach a share of the median; all of them if none does. A group may have most of the boxes."""
    width, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    sides = {"_w": width, "_h": height, "_a": width * height}
    rows = spreads.ranged(boxes, [*by, *BOX])
    medians = spreads.quantiles(rows, by, sides, {"median": 0.5}).drop("_w_n", "_h_n", "_a_n")
    good = functools.reduce(lambda a, b: a & b, (x >= share * F.col(f"{c}_median") for c, x in sides.items()))
    told = spreads.joined(rows, spreads.of_ranges(rows, medians, by), by).withColumn("_good", good)
    some = told.groupBy(*by).agg(F.max("_good").alias("_any"))
    kept = spreads.joined(told, spreads.of_ranges(rows, some, by), by)
    return kept.where("_good OR NOT _any").select(*boxes.columns)


def per_group(rows: DataFrame, by: list[str], columns: list[str], kernel, ddl: str) -> DataFrame:
    """Runs a kernel of the rows of a group, given as an array in the order of `columns`, that gives tuples of `ddl`.

    A group is a page or a set of a curator and fits a task. It becomes one row, so many groups share a batch.
    """
    listed = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("_rows"))

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({**{c: pdf[c] for c in by}, "_out": [[tuple(x) for x in kernel(r)] for r in pdf["_rows"]]})

    kinds = dict(rows.dtypes)
    head = ", ".join(f"{c} {kinds[c]}" for c in by)
    made = listed.mapInPandas(run, f"{head}, _out array<struct<{ddl}>>")
    return made.select(*by, F.explode("_out").alias("_x")).select(*by, "_x.*")


def as_boxes(rows) -> np.ndarray:
    return np.array([[r[c] for c in BOX] for r in rows], float).reshape(-1, 4)


def grouped(boxes: DataFrame, by: list[str], kernel, order: str = "ord") -> DataFrame:
    """The boxes that a kernel makes of the boxes of a group, in order."""

    def run(rows) -> list[tuple]:
        return [(k, *map(float, b)) for k, b in enumerate(kernel(as_boxes(rows)), 1)]

    return per_group(boxes, by, [order, *BOX], run, "ord: long, x0: double, y0: double, x1: double, y1: double")


def reading_order(boxes: DataFrame, by: list[str]) -> DataFrame:
    """Boxes row by row: a box joins the first row whose mean centre is within max(20, 0.4 * median height) of its own."""
    return grouped(boxes, by, in_reading_order)


def in_reading_order(b: np.ndarray) -> list:
    if not len(b):
        return []
    centre = (b[:, 1] + b[:, 3]) / 2
    reach = max(20.0, 0.4 * float(np.median(b[:, 3] - b[:, 1])))
    rows: list[list[int]] = []
    for k in np.lexsort((b[:, 0], centre)):
        fits = [r for r in rows if abs(centre[k] - centre[r].mean()) <= reach]
        if fits:
            fits[0].append(k)
        else:
            rows.append([k])
    rows.sort(key=lambda r: centre[r].mean())
    return [b[k] for r in rows for k in sorted(r, key=lambda k: b[k, 0])]


def merged_boxes(boxes: DataFrame, by: list[str], w: float, h: float, gap: float = 12, most: tuple[float, float] = (0.66, 0.07)) -> DataFrame:
    """Boxes at most `gap` apart grow together, in passes until nothing changes; no merge may exceed a share of the page.

    The bound makes the result depend on the order, which is `ord`.
    """
    return grouped(boxes, by, lambda b: grown_together(b, w, h, gap, most))


def grown_together(b: np.ndarray, w: float, h: float, gap: float, most: tuple[float, float]) -> list[np.ndarray]:
    def pass_over(boxes: list[np.ndarray]) -> list[np.ndarray]:
        out, open_boxes = [], list(boxes)
        while open_boxes:
            box, rest = open_boxes[0], open_boxes[1:]
            open_boxes = []
            for other in rest:
                both = np.append(np.minimum(box[:2], other[:2]), np.maximum(box[2:], other[2:]))
                near = (box[:2] - gap <= other[2:]).all() and (other[:2] - gap <= box[2:]).all()
                if near and both[2] - both[0] <= most[0] * w and both[3] - both[1] <= most[1] * h:
                    box = both
                else:
                    open_boxes.append(other)
            out.append(box)
        return out

    now = list(b)
    while len(after := pass_over(now)) < len(now):
        now = after
    return now


# Recursive splits of sheets, on arrays.


def gutters(share: np.ndarray, least: int, at_least: float) -> list[tuple[int, int]]:
    """Bands (start, end excluded) of lines that are empty enough; gaps of two lines are bridged."""
    lines = np.flatnonzero(share >= at_least)
    if not len(lines):
        return []
    cut = np.flatnonzero(np.diff(lines) > 3)
    bands = zip(lines[np.append(0, cut + 1)], lines[np.append(cut, len(lines) - 1)] + 1, strict=True)
    return [(int(a), int(b)) for a, b in bands if b - a >= least]


def panels(empty: np.ndarray, axis: int, least_gutter: int, at_least: float, least: int) -> list[tuple[int, int]]:
    n = empty.shape[axis]
    bands = gutters(empty.mean(axis=1 - axis), least_gutter, at_least) if empty.size else []
    edges = [0, *(x for band in bands for x in band), n]
    found = [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= least]
    return found or [(0, n)]


def strength(empty: np.ndarray, axis: int, least_gutter: int, at_least: float) -> float:
    share = empty.mean(axis=1 - axis)
    means = [share[a:b].mean() for a, b in gutters(share, least_gutter, at_least)]
    return float(np.mean(means)) if means else 0.0


def cut_cells(empty: np.ndarray, axis: int, *how) -> list[tuple[int, int, int, int]]:
    """(y0, y1, x0, x1) of the cells of a cut along one axis and then, in each strip, along the other."""
    out = []
    for a, b in panels(empty, axis, *how):
        strip = empty[a:b] if axis == 0 else empty[:, a:b]
        out += [(a, b, c, d) if axis == 0 else (c, d, a, b) for c, d in panels(strip, 1 - axis, *how)]
    return out


def split_sheet(gray: np.ndarray, white: float = 245, at_least: float = 0.98, least_gutter: int = 3, least: int = 48, depth: int = 0, primary: int | None = None) -> list[tuple[int, int, int, int]]:
    """Panels (x0, y0, x1, y1) of a sheet: the axis with the stronger gutters first (columns unless rows lead by 0.05), or
    `primary` (0 rows, 1 columns) on the first level, then the other, then every cell in itself, at most seven levels deep."""
    h, w = gray.shape
    whole = [(0, 0, w, h)]
    if depth > 6 or min(h, w) < least:
        return whole
    empty = gray >= white
    if primary is None:
        primary = 0 if strength(empty, 0, least_gutter, at_least) > strength(empty, 1, least_gutter, at_least) + 0.05 else 1
    axes = (primary, 1 - primary)
    cells = next((c for a in axes if len(c := cut_cells(empty, a, least_gutter, at_least, least)) > 1), [])
    out = []
    for y0, y1, x0, x1 in cells:
        if min(y1 - y0, x1 - x0) >= least:
            inner = split_sheet(gray[y0:y1, x0:x1], white, at_least, least_gutter, min(least, max(16, min(y1 - y0, x1 - x0) // 30)), depth + 1)
            out += [(x0 + a, y0 + b, x0 + c, y0 + d) for a, b, c, d in inner]
    return out or whole


def split_sheets(sheets: DataFrame, **options) -> DataFrame:
    """(sheet, ord, x0..y1) of rows (sheet, gray: rows of numbers)."""

    def run(batches):
        for pdf in batches:
            rows = [(s, k, *map(float, box)) for s, g in zip(pdf["sheet"], pdf["gray"], strict=True) for k, box in enumerate(split_sheet(np.stack(g).astype(float), **options), 1)]
            yield pd.DataFrame(rows, columns=["sheet", "ord", *BOX])

    return sheets.select("sheet", "gray").mapInPandas(run, f"sheet {dict(sheets.dtypes)['sheet']}, ord long, x0 double, y0 double, x1 double, y1 double")


def opened(mask: np.ndarray) -> np.ndarray:
    """Eroded and dilated again by a cross of three; outside of the mask nothing is set."""

    def cross(m: np.ndarray, join) -> np.ndarray:
        p = np.pad(m, 1)
        return functools.reduce(join, (p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]))

    return cross(cross(mask, np.logical_and), np.logical_or)


def blobs(gray: np.ndarray, white: float = 245, least: int = 1, area: int = 1, opening: bool = False) -> list[tuple[int, int, int, int]]:
    """Boxes of 4-connected stretches of content of at least `area` pixels, by union of the runs of neighbouring rows."""
    content = opened(gray < white) if opening else gray < white
    parent: list[int] = []
    box: list[list[int]] = []
    pixels: list[int] = []

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    above: list[tuple[int, int, int]] = []
    for y, line in enumerate(content):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], line.astype(np.int8), [0]])))
        here = []
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            k = len(parent)
            parent.append(k), box.append([int(a), y, int(b), y + 1]), pixels.append(int(b - a))
            for c, d, other in above:
                if c < b and a < d:
                    r, s = sorted((root(k), root(other)))
                    if r != s:
                        parent[s] = r
                        pixels[r] += pixels[s]
                        box[r] = [min(box[r][0], box[s][0]), min(box[r][1], box[s][1]), max(box[r][2], box[s][2]), max(box[r][3], box[s][3])]
            here.append((int(a), int(b), k))
        above = here
    return [tuple(box[k]) for k in range(len(parent)) if root(k) == k and min(box[k][2] - box[k][0], box[k][3] - box[k][1]) >= least and pixels[k] >= area]
