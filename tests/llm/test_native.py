"""Sharding, mixing and exact deduplication against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

from assayer.llm import exact_dedup, mixing, sharding


def key(r):
    return (r.doc_id is None, r.doc_id or 0)


def test_exact_dedup(odd, none):
    groups = defaultdict(list)
    for r in odd.collect():
        groups[re.sub(r"[\x20\x09-\x0d]+", " ", r.text or "")].append(r)
    got = exact_dedup.exact_dedup(odd).collect()
    want = Counter()
    for text, rows in groups.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        first = min(rows, key=key).doc_id
        for k, r in enumerate(sorted(rows, key=key)):
            want[(r.doc_id, first, len(rows), k == 0, sha)] += 1
    assert Counter(map(tuple, got)) == want
    assert exact_dedup.exact_dedup(none).count() == 0
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns and kept.count() == len(groups)


def test_many_runs_and_a_hot_group(spark):
    docs = spark.range(5000, numPartitions=40).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot  text' ELSE concat('t', id % 1000) END AS text")
    rows = exact_dedup.digests(docs)
    groups = exact_dedup.merge_runs(rows, fan_in_bits=1).collect()
    assert max(g.group_size for g in groups) == 1667 and sum(g.group_size for g in groups) == 5000
    got = exact_dedup.exact_dedup(docs)
    assert got.where("kept").count() == len(groups) and {r.keep_id for r in got.where("group_size = 1667").collect()} == {0}


def test_shards(spark, odd, none):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('é', CAST(id % 50 AS int)) AS text", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE concat('s', id % 11) END AS source")
    rows = sharding.interleave(docs, 24).collect()
    count = Counter(r.shard for r in rows)
    assert set(count) == set(range(24)) and max(count.values()) - min(count.values()) <= 1
    for s, n in count.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    for source, n in Counter(r.source for r in rows).items():
        each = Counter(r.shard for r in rows if r.source == source)
        assert all(abs(each[s] - n / 24) <= 2 for s in range(24)), source
    assert all(r.size == 2 * (r.doc_id % 50) + 8 and r.text_crc32 == zlib.crc32(("é" * (r.doc_id % 50)).encode()) for r in rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, sharding.interleave(docs.repartition(7), 24).collect())) if all(r.source for r in rows) else True
    few = sharding.sharding(odd).collect()
    assert len(few) == odd.count() and all(r.slot == 0 for r in few)
    assert sharding.sharding(none).count() == 0


def test_written_shards(spark, odd, tmp_path):
    docs = odd.drop("size", "row")
    sharding.write_shards(docs, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == odd.count() and {"text", "lang", "n_chars", "slot", "shard"} <= set(back.columns)


def targets(sizes):
    """Reshare what full sources can't take until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full, total = set(), 1.5 * sum(sizes.values())
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and left * weight[s] / share > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in full else left * weight[s] / share for s in names}
        full |= over


def test_mixture(spark, odd, none):
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat('w ', CAST(id % 40 AS int)) AS text", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE concat('s', id % 11) END AS source")
    source = {r.doc_id: r.source for r in docs.collect()}
    rows = mixing.mixing(docs).collect()
    sizes = Counter()
    for r in rows:
        assert r.size == r.doc_id % 40 and r.taken <= 2 * r.size
        sizes[source[r.doc_id]] += r.size
    want = targets(sizes)
    taken = Counter()
    for r in rows:
        assert r.source_size == sizes[source[r.doc_id]] and abs(r.target - want[source[r.doc_id]]) < 1e-6 * max(1, r.target)
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) < 0.2 * want[s] for s in want)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mixing(docs.repartition(5)).collect()))
    mix = Counter(r.doc_id for r in mixing.mix(docs).collect())
    assert all(mix[r.doc_id] == r.copies for r in rows)
    assert mixing.mixing(odd).count() == odd.count() and mixing.mix(odd).columns == odd.columns
    assert mixing.mixing(none).count() == 0 and mixing.mix(none).count() == 0
