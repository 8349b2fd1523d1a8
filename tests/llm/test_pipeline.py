import hashlib
import re
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from assayer.llm import bpe, mixing, toxicity
from tests.llm.test_native import targets
from tests.llm.test_ngram_join import brute

tokenizers = pytest.importorskip("tokenizers")
SF = "/root/testdata/sf0.001"


def drawn(rows):
    """Copies of every document: its source's rate by filling and resharing, and one draw by MD5."""
    size = Counter()
    for _, text, source in rows:
        size[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text))
    want = targets(size)
    out = {}
    for i, _, source in rows:
        rate = min(2.0, want[source] / size[source]) if size[source] else 0.0
        draw = int(hashlib.md5(f"23:{i}".encode()).hexdigest()[:15], 16) / 2**60
        out[i] = int(rate) + (draw < rate - int(rate))
    return out


def test_rows_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = {r.doc_id for r in toxicity.toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.predicted}
    rows = [r for r in docs.orderBy("doc_id").collect() if r.doc_id not in toxic]
    seen, kept = set(), []
    for r in rows:
        text = " ".join(x for x in r.text.replace("\t", " ").replace("\n", " ").split(" "))
        while "  " in text:
            text = text.replace("  ", " ")
        if text not in seen:
            seen.add(text), kept.append(r)
    first = {i for i, _, c in brute([(r.doc_id, r.text) for r in kept]) if i == c}
    kept = spark.createDataFrame([r for r in kept if r.doc_id in first], docs.schema)
    copies = drawn([(r.doc_id, r.text, r.source) for r in kept.collect()])
    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    want = Counter()
    for r in kept.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want[(r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))] += copies[r.doc_id]
    got = Counter(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert got == +want and len(got) > 20


def test_stages_keep_columns_and_odd_rows(spark, odd, none):
    for df in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, SF)
            assert out.columns == df.columns and out.count() <= 2 * df.count(), name
        assert corpus_pipeline.STAGES[-1][1](spark, df, SF).count() == df.count()


def test_copies_of_null_ids(spark):
    docs = spark.createDataFrame([(None, "same text"), (None, "same  text"), (3, "same text"), (3, "same text")], "doc_id long, text string")
    left = corpus_pipeline.distinct(spark, docs, SF).collect()
    assert [(r.doc_id, r.text) for r in left] == [(3, "same text")]


@pytest.mark.parametrize("stage", ["mixed"])
def test_mixture_is_near_its_targets(spark, stage):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = mixing.mixing(docs).withColumn("s", F.col("source_size"))
    sums = got.groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) < 0.15 * r.target for r in sums)
