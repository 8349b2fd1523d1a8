import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assayer.llm import ngram_join
from assayer.llm.components import components


def brute(rows):
    sets = []
    for _, text in rows:
        w = [x for x in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if top(m) == top(k) and rows[m][0] is not None]
        out.append((i, len(sets[k]), min(ids) if ids and sets[k] else i))
    return sorted(out, key=str)


def result(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(map(tuple, ngram_join.ngram_join(df).collect()), key=str)


def test_groups_and_edges(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(3000)]
    rows, n = [], 0
    passage = " ".join(rng.choice(words) for _ in range(60))
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([4, 12, 60, 200]))]
        for _ in range(rng.choice([1, 2, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            text = " ".join(copy)
            if rng.random() < 0.3:
                text += " " + passage
            rows.append((n, text.upper() if rng.random() < 0.2 else text))
            n += 1
    rows += [(n, ""), (n + 1, None), (n + 2, "one two"), (n + 3, "One  two"), (None, "one two"), (None, None), (n + 2, "one two")]
    assert result(spark, rows) == brute(rows)


def test_large_group_of_near_copies(spark):
    rng = random.Random(2)
    base = [f"v{k}" for k in range(120)]
    rows = []
    for k in range(700):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 6])):
            copy[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    assert result(spark, rows) == brute(rows)


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(map(tuple, ngram_join.ngram_join(odd).collect()), key=str) == brute(rows)
    assert ngram_join.ngram_join(none).count() == 0
    assert ngram_join.drop_near_copies(odd).columns == odd.columns


def test_components(spark):
    chain = [(k, k + 1) for k in range(300)] + [(1000, k) for k in range(1001, 1100)] + [(5, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == dict.fromkeys(range(301), 0) | dict.fromkeys(range(1000, 1100), 1000)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "b", "É", " "]), max_size=12))
def test_shingle_counts(words):
    h = ngram_join.shingles(" \t".join(words), ngram_join.WordHashes())
    assert len(h) == brute([(1, " ".join(words))])[0][1]


def test_components_that_did_not_converge_are_an_error(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        components(chain, rounds=1).count()
