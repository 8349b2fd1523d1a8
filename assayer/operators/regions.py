"""Connected regions of masks, as tables of runs.

A picture's mask is rows (by, y, and `line`, an array of what is content), whole lines or pieces of lines that begin at `x`. Runs of
content are found within each line by array functions; runs that touch, above each other or end to end where two tiles meet, are
edges of a graph, and a region is a component of it. No picture has to be in one task: its lines are rows like any others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components

#: Places of a line that share a bucket, in which the runs of neighbouring lines meet.
BUCKET = 64


def lines_of(pictures: DataFrame, by: list[str], content: Column) -> DataFrame:
    """(by, y, line) of pictures whose mask is an array of arrays."""
    return pictures.select(*by, F.posexplode(content).alias("y", "line"))


def opened(lines: DataFrame, by: list[str]) -> DataFrame:
    """Whole lines eroded and dilated again by a cross of three; outside of the mask nothing is set."""
    w = Window.partitionBy(*by).orderBy("y")

    def cross(rows: DataFrame, join) -> DataFrame:
        near = rows.withColumns({"_up": F.lag("line").over(w), "_down": F.lead("line").over(w), "_yu": F.lag("y").over(w), "_yd": F.lead("y").over(w)})
        at = lambda c, k: F.coalesce(F.get(F.col(c), k), F.lit(False))
        up = lambda k: F.coalesce(F.col("_yu") == F.col("y") - 1, F.lit(False)) & at("_up", k)
        down = lambda k: F.coalesce(F.col("_yd") == F.col("y") + 1, F.lit(False)) & at("_down", k)
        left = lambda k: F.when(k > 0, at("line", F.greatest(k - 1, F.lit(0)))).otherwise(F.lit(False))
        new = F.transform("line", lambda v, k: join(join(v, left(k), at("line", k + 1)), up(k), down(k)))
        return near.select(*rows.columns[:-1], new.alias("line"))

    rows = lines.select(*by, "y", "line")
    return cross(cross(rows, lambda a, b, c: a & b & c), lambda a, b, c: a | b | c)


def runs_of(lines: DataFrame, by: list[str], x: str | None = None) -> DataFrame:
    """(by, y, start, stop) of every run of content in a line, or in a piece of one that begins at `x`; nulls aren't content."""
    on = F.transform("line", lambda v: F.coalesce(v, F.lit(False)))
    off = F.col(x) if x else F.lit(0)
    size = F.size("_on")
    starts = F.filter(F.sequence(F.lit(0), size), lambda k: (k < size) & F.get("_on", k) & ((k == 0) | ~F.get("_on", F.greatest(k - 1, F.lit(0)))))
    stops = F.filter(F.sequence(F.lit(1), size + 1), lambda k: (k <= size) & F.get("_on", k - 1) & ((k == size) | ~F.coalesce(F.get("_on", k), F.lit(False))))
    found = lines.withColumn("_on", on).select(*by, "y", off.alias("_x"), F.explode(F.arrays_zip(starts.alias("a"), stops.alias("b"))).alias("r"))
    return found.select(*by, "y", (F.col("_x") + F.col("r.a")).cast("long").alias("start"), (F.col("_x") + F.col("r.b")).cast("long").alias("stop"))


def touching(runs: DataFrame, by: list[str]) -> DataFrame:
    """Edges (by, u, v) between runs that share a side; a run's number is made of its line and start."""
    # Bucket of each place of a run and the next one: that is where the run that begins there has its first.
    spread = runs.withColumn("id", (F.col("y") * (1 << 32) + F.col("start")).cast("long")).withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / BUCKET), F.floor(F.col("stop") / BUCKET))))
    a, b = spread.alias("a"), spread.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by] + [F.col("a._b") == F.col("b._b")]
    col = F.col
    above = (col("b.start") < col("a.stop")) & (col("a.start") < col("b.stop")) & (col("a._b") == F.floor(F.greatest("a.start", "b.start") / BUCKET))
    below = a.join(b, [*same, col("b.y") == col("a.y") + 1, above])
    beside = a.join(b, [*same, col("b.y") == col("a.y"), col("b.start") == col("a.stop"), col("a._b") == F.floor(col("b.start") / BUCKET)])
    pick = lambda d: d.select(*(col(f"a.{c}").alias(c) for c in by), col("a.id").alias("u"), col("b.id").alias("v"))
    return pick(below).unionByName(pick(beside))


def regions(lines: DataFrame, by: list[str], x: str | None = None, area: int = 1, least: int = 1) -> DataFrame:
    """(by, x0, y0, x1, y1, pixels) of the 4-connected regions with at least `area` pixels and `least` on either side; ends are excluded.

    Lines that are missing are empty; pieces of a line must not overlap. Masks without content give nothing.
    """
    keyed = lines.withColumn("_g", F.struct(*by))  # nulls within a struct are equal
    runs = runs_of(keyed, ["_g"], x).withColumn("node", (F.col("y") * (1 << 32) + F.col("start")).cast("long"))
    found = components(touching(runs.drop("node"), ["_g"]), ["_g"])
    rooted = runs.join(found, ["_g", "node"], "left").withColumn("root", F.coalesce("root", "node"))
    boxes = rooted.groupBy("_g", "root").agg(
        F.min("start").alias("x0"), F.min("y").cast("long").alias("y0"), F.max("stop").alias("x1"), (F.max("y") + 1).cast("long").alias("y1"), F.sum(F.col("stop") - F.col("start")).alias("pixels"))
    large = boxes.where((F.col("pixels") >= area) & (F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) >= least))
    return large.select("_g.*", "x0", "y0", "x1", "y1", "pixels")
