"""Measurements of pixel patches held as flat arrays, as array expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import thresholds as T


def mean(px: Column) -> Column:
    return F.aggregate(px, F.lit(0.0), lambda a, x: a + x) / F.size(px)


def variance(px: Column) -> Column:
    """Population variance."""
    m = mean(px)
    return F.aggregate(px, F.lit(0.0), lambda a, x: a + F.pow(x - m, F.lit(2.0))) / F.size(px)


def clipped(px: Column) -> Column:
    """Share of pixels that are too dark or too bright; an empty patch counts as clipped."""
    bad = F.size(F.filter(px, lambda x: (x < T.DARK_PIXEL) | (x > T.BRIGHT_PIXEL)))
    return F.when(F.size(px) == 0, 1.0).otherwise(bad / F.size(px))


def split(px: Column, width: int) -> Column:
    """Difference of the means of the left and right halves, as a share of 255."""
    middle = max(1, width // 2)
    left = F.filter(px, lambda _, k: k % width < middle)
    right = F.filter(px, lambda _, k: k % width >= middle)
    return F.when(F.size(right) == 0, 0.0).otherwise(F.abs(mean(left) - mean(right)) / 255.0)


def laplacian(px: Column, width: int, height: int) -> Column:
    """The four-neighbour Laplacian; borders are reflected without repeating the edge."""

    def at(x: Column, y: Column) -> Column:
        mirror = lambda v, n: F.abs(F.lit(n - 1) - F.abs(F.lit(n - 1) - F.abs(v)))
        return F.element_at(px, (mirror(y, height) * width + mirror(x, width) + 1).cast("int"))

    def cell(k: Column) -> Column:
        x, y = k % width, F.floor(k / width).cast("int")
        return at(x - 1, y) + at(x + 1, y) + at(x, y - 1) + at(x, y + 1) - 4 * F.element_at(px, (k + 1).cast("int"))

    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), cell)


def histogram(pixels: DataFrame, by: list[str], px: str = "px", bins: int = 16, top: float = 256.0) -> DataFrame:
    """(by, bin, n): counts of equal bins, by exploding and a partial count."""
    each = pixels.select(*by, F.explode(px).alias("x")).withColumn("bin", F.floor(F.col("x") * bins / top).cast("long"))
    return each.groupBy(*by, "bin").agg(F.count("*").alias("n"))


def hues(pixels: DataFrame, by: list[str]) -> DataFrame:
    """(by, hue, n, share): of the 180 hues of pixels (r, g, b), by partial counts; grey has hue 0."""
    r, g, b = (F.col(c).cast("double") for c in "rgb")
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = F.nullif(top - low, F.lit(0.0))
    turn = F.when(top == r, 60 * (g - b) / span).when(top == g, 120 + 60 * (b - r) / span).otherwise(240 + 60 * (r - g) / span)
    hue = F.pmod(F.bround(F.pmod(F.coalesce(turn, F.lit(0.0)), F.lit(360.0)) / 2, 0).cast("long"), F.lit(180))
    counted = pixels.groupBy(*by, hue.alias("hue")).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def spread(px: Column) -> Column:
    """max, median and p90 (interpolated between neighbours) and standard deviation of an array."""
    ordered = F.array_sort(px)

    def quantile(q: float) -> Column:
        place = (F.size(px) - 1) * F.lit(q)
        low = F.floor(place).cast("int")
        at = lambda k: F.element_at(ordered, F.least(k, F.size(px) - 1) + 1)
        return at(low) + (place - low) * (at(low + 1) - at(low))

    return F.struct(F.array_max(px).alias("top"), quantile(0.5).alias("median"), quantile(0.9).alias("p90"), F.sqrt(variance(px)).alias("deviation"))


def line_means(px: Column, width: int, height: int, test, rows: bool = True) -> Column:
    """The share of pixels of each row, or of each column, for which a test holds."""
    hit = F.transform(px, lambda x: F.when(test(x), 1.0).otherwise(0.0))
    lines, across = (height, width) if rows else (width, height)
    place = (lambda k, j: k * width + j) if rows else (lambda k, j: j * width + k)
    line = lambda k: F.transform(F.sequence(F.lit(0), F.lit(across - 1)), lambda j: F.element_at(hit, (place(k, j) + 1).cast("int")))
    return F.transform(F.sequence(F.lit(0), F.lit(lines - 1)), lambda k: F.aggregate(line(k), F.lit(0.0), lambda a, x: a + x) / across)


def region_boxes(pixels: DataFrame, by: list[str]) -> DataFrame:
    """(by, x0, y0, x1, y1), ends excluded, of the pixels (x, y) of each region."""
    return pixels.groupBy(*by).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"))


def combined(a: Column, b: Column, both: bool) -> Column:
    """Masks as arrays of booleans, joined by and, or by or."""
    return F.zip_with(a, b, lambda x, y: x & y if both else x | y)


def measured(patches: DataFrame, px: str = "px", width: int = 8, height: int = 8) -> DataFrame:
    """Adds mean, clipped, split and the Laplacian's variance."""
    p = F.col(px)
    return patches.withColumn("_lap", laplacian(p, width, height)).withColumns(
        {"mean": mean(p), "clipped": clipped(p), "split": split(p, width), "variance": variance(F.col("_lap"))}).drop("_lap")
