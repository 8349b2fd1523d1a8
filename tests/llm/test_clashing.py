"""Extra columns with names of the operators' own, rows without identifier, and sources beyond the broadcast's bound."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from assayer.llm import exact_dedup, mixing, ngram_join, sharding, toxicity
from tests.llm.conftest import kept_apart


def test_stages_keep_clashing_columns(spark, clashing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, 0)], "doc_id long, toxic int")
    for stage in (mixing.mix, exact_dedup.drop_copies, ngram_join.drop_near_copies, lambda d: toxicity.drop_toxic(d, labels)):
        out = stage(clashing)
        rows = out.collect()
        assert out.columns == clashing.columns and rows and kept_apart(rows)


def test_queries_ignore_clashing_columns(spark, odd, clashing):
    for query in (mixing.mixing, exact_dedup.exact_dedup, ngram_join.ngram_join, sharding.sharding):
        plain, extra = (sorted(map(str, query(d).collect())) for d in (odd, clashing))
        assert plain == extra


def test_written_shards_keep_clashing_columns(spark, clashing, tmp_path):
    sharding.write_shards(clashing, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    rows = back.collect()
    assert len(rows) == clashing.count() and kept_apart(rows)
    added = [c for c in back.columns if c not in clashing.columns]
    assert len(added) == 2 and Counter(r[next(c for c in added if "shard" in c)] for r in rows).keys() <= {0, 1, 2}


def test_rows_without_identifier_are_drawn_apart(spark):
    docs = spark.range(6000).selectExpr("CAST(NULL AS long) AS doc_id", "concat(repeat('w ', 10), id) AS text", "concat('s', id % 3) AS source")
    sums = mixing.mixing(docs).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert sum(r.taken for r in sums) == pytest.approx(1.5 * 66_000, rel=0.05)
    assert all(abs(r.taken - r.target) < 0.1 * r.target for r in sums)
    placed = sharding.interleave(docs, 24)
    assert placed.select("shard", "slot").distinct().count() == 6000
    texts = ngram_join.drop_near_copies(docs.limit(40).unionByName(docs.limit(40)))
    assert texts.count() == texts.select("text").distinct().count()


def test_many_sources(spark, monkeypatch):
    docs = spark.range(3000).selectExpr(
        "id AS doc_id", "repeat('w ', CAST(id % 9 AS int)) AS text", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 50) END AS source")
    few = sorted(map(tuple, mixing.mixing(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 10)
    assert sorted(map(tuple, mixing.mixing(docs).collect())) == few
    assert Counter(map(tuple, mixing.mix(docs).collect())).total() == sum(r[5] for r in few)


def test_shards_do_not_depend_on_partitions_or_slices(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "repeat('é', CAST(id % 50 AS int)) AS text", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 11) END AS source")
    want = sorted(map(tuple, sharding.interleave(docs, 24).collect()))
    assert sorted(map(tuple, sharding.interleave(docs.repartition(7), 24).collect())) == want
    assert sorted(map(tuple, sharding.interleave(docs, 24, slice_bits=4).collect())) == want
