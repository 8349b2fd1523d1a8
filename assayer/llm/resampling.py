"""Importance resampling towards a target distribution, over hashed n-grams.

Features are the runs of 1 to n consecutive words of a text. Within a batch of texts, distinct words get whole numbers; a run
of g words is the pair of its first g - 1 words, as a number, and its last word, so distinct runs are found by sorting numbers.
Only then the bytes of each distinct run are put together, once, and hashed into a bucket, and what was counted or gained per
run is joined back to its places by indexing. The dictionary is a batch's own: nothing but sums per bucket is ever shuffled.

A first pass sums buckets over all documents and all target texts, which gives each bucket a gain; a second one takes the mean
gain of every document. Then scores are whole numbers between bounds that don't depend on the table, so a table of scores tells
where the cut is, and only what lies above it is sorted, by ranges.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import accumulate, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, frugal, in_parts, term_lists

BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 2024, 20, 10


def hashed(texts, n: int, buckets: int):
    """(bucket, text) of every feature of some texts, as two arrays, by size of the feature."""
    number, words = defaultdict(count().__next__), []
    for data in texts:
        words.append(np.concatenate([np.zeros(0, np.int64)] + [np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in term_lists(data)]))
    own = np.repeat(np.arange(len(words)), [len(w) for w in words])
    ids, names = np.concatenate([*words, np.zeros(0, np.int64)]), list(number)
    starts, runs, at = np.arange(len(ids)), names, ids  # where the runs of a size start, what they are, and which of them each is
    for g in range(1, n + 1):
        if g > 1:
            whole = starts + g <= len(ids)
            whole[whole] = own[starts[whole]] == own[starts[whole] + g - 1]
            starts = starts[whole]
            keys, at = np.unique(at[whole] * len(names) + ids[starts + g - 1], return_inverse=True)
            runs = [runs[k // len(names)] + b" " + names[k % len(names)] for k in keys.tolist()]
        bucket = np.fromiter((zlib.crc32(r) % buckets for r in runs), np.int64, len(runs))
        yield bucket[at], own[starts]


def bucket_counts(texts: DataFrame, n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """bucket and the number of features in it, over a column of bytes."""

    @frugal
    def run(batches):
        sums = np.zeros(buckets, np.int64)
        for b in in_parts(batches):
            for bucket, _ in hashed((x.as_py() for x in b.column(0)), n, buckets):
                sums += np.bincount(bucket, minlength=buckets)
        found = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(sums[found])], names=["bucket", "n"])

    return texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, n: int, buckets: int) -> np.ndarray:
    """Of each bucket, by how much likelier the target has it; both frames have one column of bytes."""
    both = [np.zeros(buckets), np.zeros(buckets)]
    for sums, texts in zip(both, (docs, target), strict=True):
        for r in bucket_counts(texts, n, buckets).collect():  # at most one row per bucket
            sums[r.bucket] = r.n
    s, t = both
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, n: int) -> DataFrame:
    """doc_id, words, n_features and weight of every row, of doc_id and a column of bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    @frugal
    def run(batches):
        for b in in_parts(batches):
            features, total, words = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for g, (bucket, own) in enumerate(hashed((x.as_py() for x in b.column(1)), n, len(shared.value))):
                here = np.bincount(own, minlength=b.num_rows)
                words = words if g else here
                features += here
                np.add.at(total, own, shared.value[bucket])
            weight = total // np.maximum(features, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (words, features, weight))], names=["doc_id", "words", "n_features", "weight"])

    return docs.mapInArrow(run, "doc_id long, words long, n_features long, weight long")


def noise(id_col: str = "doc_id", seed: int = SEED) -> Column:
    """A whole number drawn from Gumbel's distribution by the identifier; null draws as the text "null"."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def placed(rows: DataFrame, quota: int) -> DataFrame:
    """The rows of the `quota` highest scores with their rank, and others of the same scores with none.

    Ties go by doc_id, null last; rows that tie in that too are dealt by a hash, so that no range is larger than others. Ranges
    are sorted once and kept, then each row's rank is its place in its range after the rows of all ranges before.
    """
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("salt"))
    sorted_rows = rows.orderBy(*order).withColumn("at", F.monotonically_increasing_id())
    kept = checkpointed(sorted_rows.withColumn("range", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = kept.groupBy("range").agg(F.count("*").alias("rows"))  # one row for each partition
    starts = sizes.select("range", (F.sum("rows").over(Window.orderBy("range")) - F.col("rows")).alias("start"))
    rank = F.col("start") + F.col("at") + 1
    return kept.join(F.broadcast(starts), "range").withColumn("rank", F.when(rank <= quota, rank))


def resampled(
    docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, seed: int = SEED, least: int = LEAST_WORDS,
    percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """doc_id, n_features, weight, score, and the rank of the documents that are drawn, for every row.

    Null and empty texts have no features and weight 0; texts of any length are read whole. Rows that repeat are scored alike
    and drawn one by one. Without target texts all gains follow from the documents alone; an empty table gives an empty
    result. Other columns are not read, whatever their names.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    gain = gains(texts.select("text"), target.select(F.col(target_col).cast("binary").alias("text")), n, buckets)
    score = F.col("weight") + noise("doc_id", seed)
    rows = checkpointed(weights(texts, gain, n).withColumn("score", score).withColumn("salt", F.xxhash64(F.monotonically_increasing_id())))
    able = F.col("words") >= least
    # Gains of any table lie within 1000 * ln(2**64), noise within 1000 * ln(2**33): at most about 115,000 scores.
    scores = sorted(map(tuple, rows.where(able).groupBy("score").agg(F.count("*")).collect()), reverse=True)
    drawn, lowest = sum(c for _, c in scores) * percent // 100, 0
    for (lowest, _), so_far in zip(scores, accumulate(c for _, c in scores), strict=True):
        if so_far >= drawn:
            break
    columns = ["doc_id", "n_features", "weight", "score"]
    high = able & (F.col("score") >= lowest) & F.lit(drawn > 0)
    ranks = placed(rows.where(high), drawn).select(*columns, F.col("rank").cast("long").alias("rank"))
    return ranks.unionByName(rows.where(~high).select(*columns, F.lit(None).cast("long").alias("rank")))


def draw(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The identifiers of the documents that are drawn, by rank."""
    found = resampled(docs, target, id_col=id_col, **options)
    return found.where("rank IS NOT NULL").select("doc_id", "rank").orderBy("rank")


#: 3988292384 is the polynomial of CRC-32, bits reversed; the table of its 256 remainders is made by the rule.
ORACLE_SQL = r"""
WITH bits AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(i)),
rest AS (SELECT list(c ORDER BY i) AS t FROM bits),
d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), dw AS (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(words) AS word FROM d) GROUP BY ALL),
bw AS (
  SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark) GROUP BY word
), w AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(word)), '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT word FROM dw UNION SELECT word FROM bw), rest
), s AS (SELECT bucket, sum(n) AS s FROM dw JOIN w USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM bw JOIN w USING (word) GROUP BY bucket),
g AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (coalesce((SELECT sum(s) FROM s), 0) + 10000)::DOUBLE)
    / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket)
), m AS (SELECT r, sum(n * gain)::BIGINT AS total FROM dw JOIN w USING (word) JOIN g USING (bucket) GROUP BY r),
e AS (
  SELECT r, doc_id, len(words)::BIGINT AS n_features, CASE WHEN total IS NULL THEN 0 ELSE floor(total::DOUBLE / len(words))::BIGINT END AS weight,
    ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT::DOUBLE AS h
  FROM d LEFT JOIN m USING (r)
), x AS (SELECT r, doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM e),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS k, count(*) OVER () AS n FROM x WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= 10 * n // 100 THEN k END AS rank FROM x LEFT JOIN k USING (r)
"""
