"""Exact deduplication by a tree of merges of sorted digest runs.

Every partition first sorts and folds its own digests into one run (digest, smallest row, rows). Rounds of a
binomial tree with a fan-in of 2**k then merge runs: in each round the runs whose numbers agree but for the
last k bits meet, digest by digest, and the smallest identifier is kept. Each round is one grouped aggregation
keyed by (merged run, digest), so Spark folds a run before it moves it, and a group of copies that holds a third
of all rows enters a round as at most 2**k rows: no task ever sees the group itself. At every level two further
figures of the texts (a second hash and the length) are folded by minimum and maximum; where they differ, equal
digests would hide different texts and the run fails.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, checkpointed, heavy_split, text_of, unused


def normalised(column: str = "text"):
    return F.regexp_replace(text_of(column), SPACE, " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per document; `row` tells repeated rows apart and `run` is the partition that read it."""
    text = normalised(text_col)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.spark_partition_id().alias("run"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.xxhash64(text).alias("second"),
        F.octet_length(text).alias("bytes"),
    )


def merge_runs(rows: DataFrame, fan_in_bits: int = 4) -> DataFrame:
    """(digest, keep, group_size) over all rows of `digests`, by rounds of 2**fan_in_bits-way merges."""
    keep = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    level = rows.select(
        "run", "digest", keep.alias("keep"), F.lit(1).cast("long").alias("group_size"),
        F.struct("second", "bytes").alias("low"), F.struct("second", "bytes").alias("high"),
    )
    last = rows.agg(F.max("run")).first()[0] or 0

    def fold(runs: DataFrame) -> DataFrame:
        return runs.groupBy("run", "digest").agg(
            F.min("keep").alias("keep"), F.sum("group_size").alias("group_size"),
            F.min("low").alias("low"), F.max("high").alias("high"),
        )

    while True:
        level = fold(level.withColumn("run", F.shiftright("run", fan_in_bits)))
        last >>= fan_in_bits
        if not last:
            break
    clash = F.raise_error(F.lit("equal digests of different texts"))
    verified = F.when(F.col("low") == F.col("high"), F.col("group_size")).otherwise(clash)
    return level.select("digest", "keep", verified.cast("long").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are so after each run of ASCII white space is replaced by one space; null counts as
    empty. The row with the smallest identifier stays (a null identifier counts as the largest); of rows that
    repeat an identifier and a text exactly one stays. An empty table gives an empty result. Other columns of
    `docs` are not read, whatever their names.
    """
    rows = checkpointed(digests(docs, id_col, text_col))
    groups = checkpointed(merge_runs(rows))
    found = heavy_split(rows.select("doc_id", "row", "digest"), groups, "digest", "group_size", rows.count())
    return found.select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns and values, whatever they are called.

    Of rows that repeat an identifier and a text one stays. An empty table gives an empty result.
    """
    sha, i, nth = (unused(docs, c) for c in ("sha", "id", "nth"))
    same_id = exact_dedup(docs, id_col, text_col).where("doc_id <=> keep_id")
    firsts = checkpointed(same_id.select("doc_id", "text_sha256", "kept"))
    chosen = firsts.where("kept").select(F.col("doc_id").alias(i), F.col("text_sha256").alias(sha))
    keyed = docs.withColumn(sha, F.sha2(normalised(text_col), 256))
    left = keyed.join(chosen, (keyed[sha] == chosen[sha]) & keyed[id_col].cast("long").eqNullSafe(chosen[i]), "left_semi")
    if firsts.count() > chosen.count():  # some row repeats both, so one of them has to be told apart
        left = left.withColumn(nth, F.row_number().over(Window.partitionBy(id_col, sha).orderBy(id_col))).where(F.col(nth) == 1)
    return left.select(*docs.columns)


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""
