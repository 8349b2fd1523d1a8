"""Ranked search against a plain computation of every score."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from assayer.llm import search
from tests.llm.conftest import ODD

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, every = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    rows = []
    for item, ts in wanted.items():
        found = []
        for i, c in held:
            m = 100 - 50 + (50 * c.total() * n_docs) // every
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        rows += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(rows, key=repr)


def rows_of(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


ITEMS = [(1, "a WORD é" + "é" * 69_999), (2, "line one HERE x"), (2, "word"), (3, None), (4, "none-of-them"), (None, "b c"), (5, "")]


@pytest.mark.parametrize("k", [1, 2, 50])
def test_against_every_score(spark, odd, k):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert rows_of(search.ranked(odd, items, k)) == plain([r[:2] for r in ODD], ITEMS, k)


def test_ties_shards_and_groups_of_items(spark, monkeypatch):
    docs = [(i * 7 % 400, " ".join(f"t{j}" for j in range(i % 5, i % 5 + 4)) + (" hot" if i % 3 else "")) for i in range(400)]
    items = [(j, f"t{j} hot t{j + 1}") for j in range(6)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    whole = rows_of(search.ranked(df, spark.createDataFrame(items, "item_id long, text string"), 10))
    assert whole == plain(docs, items, 10)
    monkeypatch.setattr(search, "SHARD_DOCS", 16)
    monkeypatch.setattr(search, "GROUP_BYTES", 60)
    assert rows_of(search.ranked(df, spark.createDataFrame(items, "item_id long, text string"), 10)) == whole
    assert search.grouped(search.query_terms(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text"))[1] > 1


def test_empty_tables(spark, odd, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search.ranked(none, items).count() == 0
    assert search.ranked(odd, items.where("false")).count() == 0


def test_clashing_columns(spark, odd, clashing):
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, score string")
    assert rows_of(search.ranked(odd, items)) == rows_of(search.ranked(clashing, items))


def test_counts_of_terms():
    texts = [None, "", "a b", "-a-", "ab", "é9 Z", " ", "x" * 10, "y"]
    array = pa.array([None if t is None else t.encode() for t in texts], pa.binary())
    want = [len(terms(t)) for t in texts]
    assert search.term_counts(array).tolist() == want
    assert search.term_counts(array.slice(2, 5)).tolist() == want[2:7]
    assert search.term_counts(pa.array([], pa.binary())).tolist() == []


def test_best_of_ties():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n, k = rng.integers(1, 60), int(rng.integers(1, 20))
        scores, ids, none = rng.integers(0, 4, n), rng.integers(0, 9, n), rng.random(n) < 0.2
        want = sorted(((-s, bool(x), i) for s, i, x in zip(scores, ids, none, strict=True) if s > 0))[:k]
        got = search.best(scores, ids, none, k)
        assert [(-scores[g], bool(none[g]), ids[g]) for g in got] == want


def test_long_texts_are_listed_in_stretches(monkeypatch):
    from assayer.llm import common

    text = " ".join(f"Wort{i} é{i % 7}" for i in range(300))
    monkeypatch.setattr(common, "STRETCH", 50)
    lists = list(common.term_lists(text.encode()))
    assert len(lists) > 10 and [t.decode() for x in lists for t in x] == terms(text)
