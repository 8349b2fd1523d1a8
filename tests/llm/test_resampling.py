"""Resampling against a plain computation, n-grams included."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from assayer.llm import resampling
from tests.llm.conftest import ODD

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, n):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [" ".join(words[k : k + g]) for g in range(1, n + 1) for k in range(len(words) - g + 1)]


def plain(docs, target, n, buckets, least, percent):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t, n)[1])
    t = Counter(bucket(f) for x in target for f in features(x, n)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    rows = []
    for i, text in docs:
        words, fs = features(text, n)
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = [(*r[:4], k) for k, r in enumerate(able[: percent * len(able) // 100], 1)]
    rest = able[len(drawn) :] + [r for r in rows if r[4] < least]
    return sorted(drawn + [(*r[:4], None) for r in rest], key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=repr)


TARGET = ["a b c d", None, "", "WORD word line", "never seen é"]


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([(t,) for t in TARGET], "text string")


@pytest.mark.parametrize(("n", "buckets", "least", "percent"), [(1, 10_000, 20, 10), (1, 50, 1, 60), (2, 97, 2, 50), (3, 1000, 1, 100), (2, 7, 1, 0)])
def test_against_plain_computation(odd, target, n, buckets, least, percent):
    got = resampling.resampled(odd, target, n, buckets, least=least, percent=percent)
    assert rows_of(got) == plain([r[:2] for r in ODD], TARGET, n, buckets, least, percent)


def test_many_rows_and_ties(spark, target):
    docs = [(i % 700, " ".join(["a"] * (i % 3) + ["word"] * 20 + [f"x{i % 11}"])) for i in range(2000)] + [(None, "word " * 25)] * 900
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    got = resampling.resampled(df, target)
    assert rows_of(got) == plain(docs, TARGET, 1, 10_000, 20, 10)
    ranks = [r["rank"] for r in resampling.draw(df, target).collect()]
    assert ranks == list(range(1, 291))


def test_empty_tables(odd, none, target):
    assert resampling.resampled(none, target).count() == 0
    assert rows_of(resampling.resampled(odd, target.where("false"))) == plain([r[:2] for r in ODD], [], 1, 10_000, 20, 10)


def test_clashing_columns(odd, clashing, target):
    assert rows_of(resampling.resampled(odd, target)) == rows_of(resampling.resampled(clashing, target))


def test_each_distinct_run_is_hashed_once(monkeypatch):
    seen = []

    def crc(data):
        seen.append(data)
        return zlib.crc32(data)

    monkeypatch.setattr(resampling, "zlib", type("z", (), {"crc32": staticmethod(crc)}))
    found = list(resampling.hashed([b"a b a b a", b"a b", b""], 2, 100))
    assert sorted(seen) == [b"a", b"a b", b"b", b"b a"] and [len(b) for b, _ in found] == [7, 5]
