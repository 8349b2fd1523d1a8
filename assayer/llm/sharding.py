"""Sharding by proportional stratified interleaving.

Rows of each source are shuffled by a seeded hash and ranked; row r of n has the fractional rank (2r - 1) / 2n.
Sorting all rows by that rank deals the sources out evenly, so any contiguous cut has the mixture of the whole.
Both rankings are distributed: rows go to slices of the hash range (then of the fractional range), which are as
even within a hot source as within a small one; the number of rows before a slice comes from a table of slice
counts, and row_number() runs inside a slice only. The second table needs no pass: the number of rows of a
source below a fraction follows from n in whole numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import own_text, seeded_hash, text_of, unused

#: The seeded hash has 60 bits; slices are its upper bits.
HASH_BITS = 60
LEAST_BITS, SLICE_ROWS = 10, 2_000_000


def interleave(
    docs: DataFrame, shards: int = 24, seed: int = 17, slice_bits: int | None = None,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, source, size, text_crc32, shard, slot and the columns in `carry`, for every row.

    Row counts of any two shards differ by one at most, and slots are gapless from 0. A null source is a source
    of its own, a null text has no bytes, and rows that tie in everything are in either order. Rows without identifier
    are shuffled by their text. 2**slice_bits is the number of slices of each source's hash range and of the whole;
    unless given it grows with the rows, so that a slice has about SLICE_ROWS at most. Texts of any length are read
    whole, and an empty table gives an empty result. The columns in `carry` must not begin with an underscore.
    """
    if slice_bits is None:
        slice_bits = max(LEAST_BITS, (docs.count() // SLICE_ROWS).bit_length())
    slices = 1 << slice_bits
    text = text_of(text_col)
    crc = F.crc32(text.cast("binary"))
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("-")).alias("_stratum"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        crc.alias("text_crc32"),
        seeded_hash(seed, own_text(id_col, text_col)).alias("_hash"),
        *carry,
    ).withColumn("_slice", F.shiftright("_hash", HASH_BITS - slice_bits).cast("int"))

    counts = base.groupBy("_stratum", "_slice").agg(F.count("*").alias("_rows"))
    run = Window.partitionBy("_stratum").orderBy("_slice")
    starts = counts.select(
        "_stratum", "_slice",
        (F.sum("_rows").over(run) - F.col("_rows")).alias("_start"),
        F.sum("_rows").over(Window.partitionBy("_stratum")).alias("_n"),
    )
    within = Window.partitionBy("_stratum", "_slice").orderBy("_hash", "doc_id", "text_crc32")
    ranked = base.join(starts, ["_stratum", "_slice"]).withColumn(
        "_rank", F.col("_start") + F.row_number().over(within)
    )
    part = F.expr(f"CAST(((2 * _rank - 1) * {slices}L) DIV (2 * _n) AS INT)")
    ranked = ranked.withColumn("_part", part).withColumn("_fraction", F.expr("(2 * _rank - 1) / (2 * _n)"))

    # Rows of a source in the parts before b: those with (2r - 1) * slices < 2 * n * b.
    before = F.expr(f"((2 * _n * _part + {slices - 1}) DIV {slices}) DIV 2")
    sizes = counts.groupBy("_stratum").agg(F.sum("_rows").alias("_n"))
    firsts = (
        sizes.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        .groupBy("_part").agg(F.sum(before).cast("long").alias("_first"), F.sum("_n").alias("_all"))
    )
    inside = Window.partitionBy("_part").orderBy("_fraction", "_stratum", "_hash", "doc_id", "text_crc32")
    placed = ranked.drop("_n").join(firsts, "_part").withColumn(
        "_place", F.col("_first") + F.row_number().over(inside) - 1
    )
    shard = F.expr(f"CAST((_place * {shards}L) DIV _all AS INT)")
    return placed.withColumn("shard", shard).withColumn(
        "slot", F.expr(f"_place - (shard * _all + {shards - 1}) DIV {shards}")
    ).select("doc_id", "source", "size", "text_crc32", "shard", "slot", *carry)


def write_shards(docs: DataFrame, path: str, shards: int = 24, **options) -> None:
    """Whole rows as Parquet, a folder per shard; within a shard, rows are in slot order in each file.

    The documents' columns keep their names and values. `shard` and `slot` are added; where the documents have such
    columns themselves, the added ones are called _shard and _slot (or with as many more underscores as it takes).
    """
    taken = {c.lower() for c in docs.columns}
    shard, slot = (unused(docs, c) if c in taken else c for c in ("shard", "slot"))
    roles = {c: options.pop(c, d) for c, d in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}
    rows = docs.select(*(F.col(c).alias(k) for k, c in roles.items()), F.struct(*docs.columns).alias("whole"))
    placed = interleave(rows, shards, carry=("whole",), **{k: k for k in roles}, **options)
    named = placed.select("whole.*", F.col("shard").alias(shard), F.col("slot").alias(slot))
    named.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def sharding(docs: DataFrame, shards: int = 24) -> DataFrame:
    return interleave(docs, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source",
    )


#: 3988292384 is the polynomial of CRC-32, bits reversed; the table of its 256 remainders is made by the rule.
ORACLE_SQL = r"""
WITH bits AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(i)),
rest AS (SELECT list(c ORDER BY i) AS t FROM bits),
d AS (
  SELECT doc_id, source, coalesce('=' || source, '-') AS stratum, strlen(coalesce(text, '')) + 8 AS size,
    xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32,
    ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
  FROM documents, rest
), r AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id, text_crc32) AS k, count(*) OVER (PARTITION BY stratum) AS n FROM d
), p AS (
  SELECT *, row_number() OVER (ORDER BY (2 * k - 1) / (2 * n), stratum, h, doc_id, text_crc32) - 1 AS place, count(*) OVER () AS every FROM r
), s AS (SELECT *, (place * 24 // every)::INTEGER AS shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, place - (shard * every + 23) // 24 AS slot, NULL::INTEGER AS grown_shard, source FROM s
"""
