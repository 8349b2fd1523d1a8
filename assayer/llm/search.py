"""Ranked lexical search over postings in shards of documents.

An index is a table with one row per shard: a few thousand documents that one task read after each other, with their own
vocabulary and postings in compressed sparse rows (for each term, the places of the documents that hold it and its impact
there). Impacts are whole numbers, made when the index is built; the two totals that they need are counted by a pass before.
Shards are cut where documents are read, so building an index shuffles nothing.

A search broadcasts a group of items, of bounded size, to all shards. Each shard takes an item's terms one after the other,
adds weight times impact to a dense array with one place per document, and hands on its best k: all above the k-th score, and
of those that tie with it the ones with the smallest identifiers. Shards are merged in two levels.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import TERM_BYTES, bounded_batches, frugal, in_parts, kept_for, shared_dir, term_lists

#: Documents and terms that fill a shard, and shards of a file: a reader decodes as many rows at once as a file has.
SHARD_DOCS, SHARD_TERMS, FILE_SHARDS = 8_192, 1 << 20, 8
#: Bytes of the terms of a group of items, and parts in which the first level merges an item's candidates.
GROUP_BYTES, MERGE_PARTS = 8 << 20, 64
INDEX = "docs array<bigint>, terms array<binary>, dfs array<int>, places binary, impacts binary, n_docs bigint, n_terms bigint"

_IS_TERM = np.frombuffer(TERM_BYTES, np.uint8) != 32


def term_counts(texts: pa.BinaryArray) -> np.ndarray:
    """The number of terms of each text, by array operations on the bytes of all."""
    texts = pc.fill_null(texts, b"")
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    inside = _IS_TERM[np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]] if data else np.zeros(0, bool)
    bounds -= bounds[0]
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    before[bounds[:-1][bounds[:-1] < len(inside)]] = False
    so_far = np.concatenate([[0], np.cumsum(inside & ~before)])
    return so_far[bounds[1:]] - so_far[bounds[:-1]]


def totals(texts: DataFrame) -> tuple[int, int]:
    """Documents with at least one term, and all their terms with repeats; of a column of bytes."""

    def run(batches):
        for b in batches:
            n = term_counts(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], names=["n_docs", "n_terms"])

    both = texts.mapInArrow(run, "n_docs long, n_terms long").agg(F.sum("n_docs"), F.sum("n_terms")).first()
    return both[0] or 0, both[1] or 0


class Shard:
    """Documents that are read one after the other, and their postings."""

    def __init__(self, n_docs: int, n_terms: int):
        self.n_docs, self.n_terms, self.size = n_docs, n_terms, 0
        self.ids, self.lengths, self.terms, self.found, self.times = [], [], defaultdict(count().__next__), [], []

    def add(self, doc_id: int | None, data: bytes | None) -> None:
        """Takes a document in, if it has a term."""
        parts = [np.unique(np.fromiter(map(self.terms.__getitem__, t), np.int32, len(t)), return_counts=True) for t in term_lists(data) if t]
        if not parts:
            return
        found, times = parts[0]
        if len(parts) > 1:
            found, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            times = np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)
        self.ids.append(doc_id)
        self.lengths.append(int(times.sum()))
        self.found.append(found)
        self.times.append(times)
        self.size += self.lengths[-1]

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or self.size >= SHARD_TERMS

    def row(self) -> pa.RecordBatch:
        term, tf = np.concatenate(self.found), np.concatenate(self.times).astype(np.int64)
        place = np.repeat(np.arange(len(self.ids)), [len(f) for f in self.found])
        m = np.array([100 - 50 + (50 * n * self.n_docs) // self.n_terms for n in self.lengths], np.int64)
        impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[place])
        by_term = np.argsort(term, kind="stable")
        values = [
            pa.array([self.ids], pa.list_(pa.int64())), pa.array([list(self.terms)], pa.list_(pa.binary())),
            pa.array([np.bincount(term, minlength=len(self.terms))], pa.list_(pa.int32())),
            pa.array([place[by_term].astype("<u2").tobytes()], pa.binary()), pa.array([impact[by_term].astype("<i4").tobytes()], pa.binary()),
            pa.array([self.n_docs], pa.int64()), pa.array([self.n_terms], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(values, names=["docs", "terms", "dfs", "places", "impacts", "n_docs", "n_terms"])


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the index of all documents to a folder; documents without a term, null texts among them, aren't in it."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    n_docs, n_terms = totals(texts.select("text"))

    @frugal
    def run(batches):
        shard = Shard(n_docs, n_terms)
        for b in in_parts(batches):
            for i, data in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                shard.add(i, data.as_py())
                if shard.full():
                    yield shard.row()
                    shard = Shard(n_docs, n_terms)
        if shard.ids:
            yield shard.row()

    texts.mapInArrow(run, INDEX).write.option("maxRecordsPerFile", FILE_SHARDS).parquet(path)


def query_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id and term, once each; rows that repeat an item_id are one item that has the terms of all of them."""
    kind = items.schema[id_col].dataType

    def run(batches):
        for b in batches:
            for i, data in zip(b.column(0), b.column(1), strict=True):
                for terms in term_lists(data.as_py()):
                    found = pa.array(sorted(set(terms)), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * len(found), b.schema.field(0).type), found], names=["item_id", "term"])

    texts = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("binary"))
    return texts.mapInArrow(run, f"item_id {kind.simpleString()}, term binary").distinct()


def grouped(terms: DataFrame) -> tuple[DataFrame, int]:
    """The terms with the number of a group of items, and how many there are: twice as many until the terms of each take
    GROUP_BYTES at most, or it is a single item."""
    groups = 1
    while True:
        dealt = terms.withColumn("group", F.pmod(F.xxhash64(F.col("item_id").cast("string")), F.lit(groups)))
        size = dealt.groupBy("group").agg(F.sum(F.octet_length("term") + 16).alias("bytes"), F.min("item_id").alias("low"), F.max("item_id").alias("high"))
        if size.where((F.col("bytes") > GROUP_BYTES) & (F.col("low") != F.col("high"))).isEmpty():
            return dealt, groups
        groups *= 2


def best(scores: np.ndarray, ids: np.ndarray, none: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, equal ones by identifier (null last)."""
    found = np.flatnonzero(scores)
    if len(found) > k:
        least = -np.partition(-scores[found], k - 1)[k - 1]
        found = found[scores[found] >= least]
    return found[np.lexsort((ids[found], none[found], -scores[found]))[:k]]


def searched(index: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """The best k of each shard for one group of items: item_id, doc_id, score, part."""
    spark, kind = index.sparkSession, terms.schema["item_id"].dataType.simpleString()
    held = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t"), "n_docs").select(F.col("t.terms").alias("term"), F.col("t.dfs").alias("df"), "n_docs")
    wanted = terms.select("term").distinct()
    dfs = held.join(F.broadcast(wanted), "term").groupBy("term").agg(F.sum("df").alias("df"), F.first("n_docs").alias("n"))
    weight = F.floor(1000 * F.log((2 * F.col("n") + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    known = [(bytes(r.term), r.w) for r in dfs.select("term", weight.alias("w")).toLocalIterator()]
    number = {t: k for k, (t, _) in enumerate(known)}
    by_item = defaultdict(list)
    for r in terms.select("item_id", "term").toLocalIterator():
        if bytes(r.term) in number:
            by_item[r.item_id].append(number[bytes(r.term)])
    shared = spark.sparkContext.broadcast((str(uuid.uuid4()), [t for t, _ in known], [w for _, w in known], list(by_item.items())))

    @frugal
    def run(batches):
        key, names, weights, items = shared.value
        names = kept_for(("search", key), lambda: pa.array(names, pa.binary()))
        for batch in batches:
            for b in (batch.slice(j, 1) for j in range(batch.num_rows)):
                docs, dfs = b.column("docs").flatten(), b.column("dfs").flatten().to_numpy()
                places, impacts = (np.frombuffer(b.column(c)[0].as_buffer(), t) for c, t in (("places", "<u2"), ("impacts", "<i4")))
                ends = np.cumsum(dfs)
                at = pc.index_in(names, value_set=b.column("terms").flatten())
                at = [None if x is None else (ends[x] - dfs[x], ends[x]) for x in at.to_pylist()]
                none, ids = docs.is_null().to_numpy(zero_copy_only=False), docs.fill_null(0).to_numpy()
                who, which, sums = [], [], []
                for item, numbers in items:
                    scores = np.zeros(len(docs), np.int64)
                    for t in numbers:
                        if at[t]:
                            low, high = at[t]
                            scores[places[low:high]] += weights[t] * impacts[low:high].astype(np.int64)
                    found = best(scores, ids, none, k)
                    who += [item] * len(found)
                    which.append(found)
                    sums.append(scores[found])
                found = np.concatenate([*which, np.zeros(0, np.int64)]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(who, shape.field(0).type), docs.take(pa.array(found)), pa.array(np.concatenate([*sums, np.zeros(0, np.int64)]).astype(np.int64)),
                ], names=["item_id", "doc_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(terms.select("item_id").schema)
    return index.select("docs", "terms", "dfs", "places", "impacts").mapInArrow(run, f"item_id {kind}, doc_id long, score long")


def search(spark: SparkSession, path: str, items: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each item, over an index that `build_index` wrote.

    Items without a term that a document holds have no rows; rows that repeat an item_id are one item, a null item_id is one
    like any other. Documents that tie come by identifier, null last; rows that repeat a document rank one by one. Of a group
    of items at most GROUP_BYTES of terms are on the driver, and the index is read twice per group.
    """
    bounded_batches(spark)
    index = spark.read.parquet(path)
    dealt, groups = grouped(query_terms(items, id_col, text_col))
    found = None
    for g in range(groups):
        part = searched(index, dealt.where(F.col("group") == g), k)
        found = part if found is None else found.unionByName(part)
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    parted = found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGE_PARTS)))
    near = parted.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*order))).where(F.col("rank") <= k)
    last = near.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return last.select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The k best documents of each item, by an index in the shared folder.

    Null and empty texts, and an empty table, match nothing; texts of any length are read whole, and columns other than
    identifier and text aren't read, whatever their names.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/search-{uuid.uuid4()}"
    build_index(docs, path, id_col, text_col)
    return search(spark, path, items, k)


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), held AS (SELECT r, doc_id, len(terms) AS n, terms FROM d WHERE len(terms) > 0),
a AS (SELECT count(*) AS docs, sum(n)::BIGINT AS every FROM held),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM held) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), s AS (
  SELECT item_id, r, doc_id, sum(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT
    * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // every))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN p USING (term) JOIN held USING (r), a GROUP BY ALL
), k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50
"""
