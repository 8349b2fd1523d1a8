"""Quantiles and figures of groups that may have most of the rows, and rows joined to the figures of their group.

Nothing here gathers a group: rows lie in ranges of group and value, a range is what a task holds, and what is known of a group
is a row for every range that the group reaches into.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sinks.places import checkpointed

RANGE = "_range"


def ranged(rows: DataFrame, order: list[Column | str]) -> DataFrame:
    """The rows, kept, with the range that each lies in. Rows that are equal in the order share a range."""
    return checkpointed(rows.repartitionByRange(*order).withColumn(RANGE, F.spark_partition_id()))


def matched(rows: DataFrame, others: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join by equal keys, where null equals null; the keys of the others go."""
    names = [f"_key{k}" for k in range(len(keys))]
    named = others.select(*(F.col(c).alias(k) for c, k in zip(keys, names, strict=True)), *(c for c in others.columns if c not in keys))
    return rows.join(named, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(keys, names, strict=True)], how).drop(*names)


def joined(rows: DataFrame, figures: DataFrame, by: list[str]) -> DataFrame:
    """Rows that lie in ranges with the figures of their group and range."""
    return matched(rows, figures, [RANGE, *by])


def of_ranges(rows: DataFrame, figures: DataFrame, by: list[str]) -> DataFrame:
    """Figures of groups, once for every range in which their group has rows."""
    return matched(rows.select(RANGE, *by).distinct(), figures, by)


def quantiles(rows: DataFrame, by: list[str], columns: Mapping[str, Column], shares: Mapping[str, float]) -> DataFrame:
    """(by, <column>_<share>...): exact quantiles, interpolated between the two values around them; `<column>_n` counts the values.

    Nulls are no values, NaN is above all; a group without a value of a column has null and 0 there. Equal values of a group are
    counted where they are read, so one value that most rows have is one row; the distinct ones lie in ranges, and a value's place is
    its place in its range after the group's values in the ranges before, whose sums are a row per group and range.
    """
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("_of"), x.cast("double").alias("_value")) for c, x in columns.items())))
    long = rows.select(*by, each.alias("_x")).select(*by, "_x.*")
    keys = [*by, "_of"]
    counted = ranged(long.where("_value IS NOT NULL").groupBy(*keys, "_value").agg(F.count("*").alias("_n")), [*keys, "_value"])
    sums = counted.groupBy(RANGE, *keys).agg(F.sum("_n").alias("_sum"))
    group = Window.partitionBy(*keys)
    starts = sums.select(RANGE, *keys, (F.sum("_sum").over(group.orderBy(RANGE)) - F.col("_sum")).alias("_start"), F.sum("_sum").over(group).alias("_all"))
    within = Window.partitionBy(RANGE, *keys).orderBy("_value")
    upto = F.col("_start") + F.sum("_n").over(within)
    placed = joined(counted, starts, keys).withColumns({"_to": upto, "_from": upto - F.col("_n")})
    at = {s: (F.col("_all") - 1) * F.lit(float(q)) for s, q in shares.items()}
    holds = lambda place: (F.col("_from") <= place) & (place < F.col("_to"))
    wanted = [holds(f(p)) for p in at.values() for f in (F.floor, F.ceil)]
    few = placed.where(F.exists(F.array(*wanted), lambda x: x))

    def quantile(of: str, place: Column) -> Column:
        low, high = (F.max(F.when((F.col("_of") == of) & holds(f(place)), F.col("_value"))) for f in (F.floor, F.ceil))
        part = F.max(F.when(F.col("_of") == of, place - F.floor(place)))
        return F.when(part == 0, low).otherwise((1 - part) * low + part * high)

    found = few.groupBy(*by).agg(
        *(quantile(c, p).alias(f"{c}_{s}") for c in columns for s, p in at.items()), *(F.coalesce(F.max(F.when(F.col("_of") == c, F.col("_all"))), F.lit(0)).alias(f"{c}_n") for c in columns))
    every = matched(rows.select(*by).distinct(), found, by, "left")
    return every.select(*by, *(f"{c}_{s}" for c in columns for s in at), *(F.coalesce(f"{c}_n", F.lit(0)).alias(f"{c}_n") for c in columns))


def spread(rows: DataFrame, by: list[str], value: Column) -> DataFrame:
    """(by, n, top, median, p90, deviation) of the values of groups: kernels.spread for values that are rows."""
    found = quantiles(rows, by, {"v": value}, {"median": 0.5, "p90": 0.9})
    plain = rows.select(*by, value.cast("double").alias("_v")).groupBy(*by).agg(F.max("_v").alias("top"), F.stddev_pop("_v").alias("deviation"))
    return matched(found, plain, by).select(*by, F.col("v_n").alias("n"), "top", F.col("v_median").alias("median"), F.col("v_p90").alias("p90"), "deviation")
