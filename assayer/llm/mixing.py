"""Mixing sources to target weights by repetition rates.

Tokens are summed per source. Targets share a budget by weight, each up to a multiple of its source; what a full
source can't take is shared by weight among the others. A document of a source with rate t / n is emitted
floor(t / n) times, and once more where a seeded hash of its identifier falls below the fraction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WORD, checkpointed, heavy_split, own_text, seeded_hash, text_of, unused

#: 60 bits of the hash.
HASH_RANGE = float(1 << 60)


def words(column: str = "text"):
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def stratum(column: str = "source"):
    """The source as a key that is never null and sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit("~"))


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """_stratum, source_size, target and rate for a table (_stratum, source_size) of the sources.

    Sources take `weights` in turn. With cap c = most * size, filling by weight stops source by source in the
    order of c / w: a source is full if its cap is at most its share of what the sources before it have left.
    """
    order = Window.orderBy("_stratum")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_nth") % len(weights)).cast("int") + 1)
    weighed = sizes.withColumn("_nth", F.row_number().over(order) - 1).withColumn("_weight", weight).withColumn(
        "_cap", F.col("source_size") * F.lit(most)
    )
    fill = Window.orderBy(F.col("_cap") / F.col("_weight"), "_stratum")
    whole = Window.partitionBy()
    left = F.lit(share) * F.sum("source_size").over(whole) - (F.sum("_cap").over(fill) - F.col("_cap"))
    open_weight = F.sum("_weight").over(whole) - (F.sum("_weight").over(fill) - F.col("_weight"))
    level = weighed.withColumn("_level", left / open_weight)
    open_level = F.min(F.when(F.col("_cap") > F.col("_level") * F.col("_weight"), F.struct(
        (F.col("_cap") / F.col("_weight")).alias("at"), F.col("_stratum"), F.col("_level").alias("level")))).over(whole)
    target = F.when(open_level.isNull(), F.col("_cap")).otherwise(
        F.least(F.col("_cap"), open_level["level"] * F.col("_weight"))
    )
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.col("target") / F.col("source_size"))).otherwise(0.0)
    return level.withColumn("target", target).select("_stratum", "source_size", "target", rate.alias("rate"))


def with_targets(rows: DataFrame, sizes: DataFrame, key: str = "_stratum") -> DataFrame:
    """Join with the sources' targets on the key. `sizes` is (_stratum, source_size, n), n rows each.

    Sources are broadcast if they are BROADCAST_ROWS at most; else those with most rows are (heavy_split), and no
    source of the others is large.
    """
    sizes = checkpointed(sizes)
    targets = source_targets(sizes.select("_stratum", "source_size")).join(sizes.select("_stratum", "n"), "_stratum")
    targets = checkpointed(targets.withColumnRenamed("_stratum", key))
    sources, total = targets.agg(F.count("*"), F.sum("n")).first()
    if sources <= BROADCAST_ROWS:
        return rows.join(F.broadcast(targets), key)
    return heavy_split(rows, targets, key, "n", total)


def copies(seed: int, rate, id_col: str = "doc_id", text_col: str = "text"):
    """floor(rate) and one Bernoulli copy for the fraction."""
    extra = seeded_hash(seed, own_text(id_col, text_col)) / F.lit(HASH_RANGE) < rate - F.floor(rate)
    return (F.floor(rate) + F.when(extra, 1).otherwise(0)).cast("int")


def mixing(docs: DataFrame, seed: int = 23) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every row; null texts have size 0.

    Rows that repeat an identifier share its draw; rows without one are drawn by their text. A source without words
    has a target of 0 and gives nothing; a null source is the last one. Texts of any length are read whole, an empty
    table gives an empty result, and other columns of `docs` are not read.
    """
    draw = seeded_hash(seed, own_text()) / F.lit(HASH_RANGE)
    rows = checkpointed(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), stratum().alias("_stratum"), words().alias("size"), draw.alias("_draw")))
    sizes = rows.groupBy("_stratum").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    rate = F.col("rate")
    taken = (F.floor(rate) + F.when(F.col("_draw") < rate - F.floor(rate), 1).otherwise(0)).cast("int")
    return with_targets(rows, sizes).withColumn("copies", taken).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def mix(docs: DataFrame, seed: int = 23) -> DataFrame:
    """The mixture: every row as often as the mix takes it, with the columns and values it has, whatever they are called.

    Nulls, ties and empty tables as in mixing().
    """
    key, row, times = (unused(docs, c) for c in ("stratum", "row", "copy"))
    sizes = docs.select(stratum().alias("_stratum"), words().alias("_size")).groupBy("_stratum").agg(
        F.sum("_size").alias("source_size"), F.count("*").alias("n"))
    keyed = docs.select(stratum().alias(key), F.struct(*docs.columns).alias(row))
    drawn = with_targets(keyed, sizes, key)
    drawn = drawn.select(F.col(row), copies(seed, F.col("rate"), f"{row}.doc_id", f"{row}.text").alias(times)).where(F.col(times) > 0)
    return drawn.select(row, F.explode(F.sequence(F.lit(1), times)).alias(times)).select(f"{row}.*")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || source, '~') AS stratum,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), s AS (
  SELECT stratum, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size) AS cap,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY stratum)) - 1) % 3 + 1]::DOUBLE AS w
  FROM d GROUP BY stratum
), o AS (
  SELECT *, row_number() OVER (ORDER BY cap / w, stratum) AS k,
         1.5::DOUBLE * sum(source_size) OVER () AS budget, sum(w) OVER () AS all_w FROM s
), f AS (
  SELECT o.*, (budget - coalesce(sum(cap) OVER b, 0)) / (all_w - coalesce(sum(w) OVER b, 0)) AS level
  FROM o WINDOW b AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (SELECT (SELECT arg_min(level, k) FROM f WHERE cap > level * w) AS level),
t AS (SELECT stratum, source_size, CASE WHEN l.level IS NULL THEN cap ELSE least(cap, l.level * w) END AS target FROM f, l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN least(2.0, target / source_size) ELSE 0.0 END AS rate FROM t)
SELECT doc_id, size, source_size, target, size * c AS taken, c AS copies FROM (
  SELECT d.doc_id, d.size, r.source_size, r.target, (floor(rate) + CASE WHEN
    ('0x' || substr(md5('23:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT / 1152921504606846976.0
    < rate - floor(rate) THEN 1 ELSE 0 END)::INTEGER AS c
  FROM d JOIN r USING (stratum))
"""
