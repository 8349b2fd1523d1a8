import math
import random
import re

import numpy as np
import pytest

from assayer.llm import cotraining


def rows(n=600):
    rng = random.Random(2)
    out = []
    for k in range(n):
        good = rng.random() < 0.7
        words = ["".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 90))]
        if not good:
            words = [w + rng.choice(["$$$", "***", "&&&"]) for w in words]
        source = f"site{rng.randrange(5) + 5 * (good == (rng.random() < 0.8))}"
        out.append((k, " ".join(words), "en", source, 1, int(good)))
    return out


def test_held_out_accuracy(spark):
    data = rows()
    docs = spark.createDataFrame([r[:5] for r in data], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], r[5]) for r in data if r[0] % 3], "doc_id long, quality int")
    got = {r.doc_id: r for r in cotraining.quality(docs, labels).collect()}
    held = [got[r[0]].predicted == r[5] for r in data if got[r[0]].held_out]
    assert len(got) == len(data) and sum(held) / len(held) > 0.97
    assert len({round(r.page_score, 6) for r in got.values()}) <= 12


def test_pseudo_labels_help_the_other_view():
    rng = np.random.default_rng(1)
    y = (rng.random(3000) < 0.5).astype(float)
    first = np.stack([np.ones(3000), 2 * y - 1 + rng.normal(0, 0.3, 3000)], 1)
    second = np.concatenate([np.ones((3000, 1)), (2 * y - 1)[:, None] * 0.15 + rng.normal(0, 1, (3000, 30))], 1)
    labelled = np.arange(3000) < 30
    apart = np.zeros(30, bool)
    model = cotraining.co_train((first[labelled], second[labelled]), y[labelled], apart, (first[~labelled], second[~labelled]))
    alone = cotraining.fit(second[labelled], y[labelled])
    right = lambda w: (((second @ w) > 0) == (y > 0))[~labelled].mean()
    assert right(model.page) > right(alone) + 0.02


def test_rows_beyond_the_labelled_sample_take_part(spark, monkeypatch):
    """The sample bounds labelled rows only: all unlabelled rows are in the pool, and the pool is that of rows at hand."""
    data, seen = rows(), []
    docs = spark.createDataFrame([r[:5] for r in data], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], r[5]) for r in data if r[0] % 3], "doc_id long, quality int")
    inner = cotraining.co_train
    monkeypatch.setattr(cotraining, "co_train", lambda *a: seen.append(a) or inner(*a))
    model = cotraining.train(docs, labels, sample=150)
    views, y, apart, free = seen[0]
    assert len(y) == 150
    assert free.total(lambda v, ties: np.array([float(len(ties))]))[0] == 200
    at_hand = cotraining.Rows(cotraining.unpacked(free.rows.select("views").toArrow().column(0).combine_chunks()))
    at_hand.ties = np.array([r.tie for r in free.rows.select("tie").collect()])
    other = inner(views, y, apart, at_hand)
    assert np.allclose(model.text, other.text) and np.allclose(model.page, other.page)


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (6, None), (99, 0)], "doc_id long, quality int")
    got = cotraining.quality(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert cotraining.quality(none, labels).count() == 0
    assert cotraining.quality(odd, labels.where("false")).count() == odd.count()


def figures(text):
    """The text view by its definition, in plain loops."""
    raw = text.encode()
    n = max(1, len(raw))

    def kind(b):
        c = chr(b)
        if b >= 128:
            return 6
        return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c in "\t\n\v\f\r " else 4 if c in ".,;:!?'\"()-" else 5

    shares = [sum(kind(b) == k for b in raw) / n for k in range(7)]
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", raw) if w]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    m, k = max(1, len(words)), max(1, len(lines))
    again = sum(words[j] == words[j + 1] for j in range(len(words) - 1))
    marks = sum(1 for w in words if w[-1] < 128 and not chr(w[-1]).isalnum())
    bare = sum(1 for w in words if all(chr(b) in ".,;:!?'\"()-|" for b in w))
    most = max((words.count(w) for w in words), default=0)
    return [1.0, *shares, len(set(words)) / m, most / m, again / m, marks / m, bare / m, min(3.0, len(raw) / m / 8), math.log(1 + m) / 8,
            len(set(lines)) / k, min(3.0, m / k / 30), sum(x.count(b"|") for x in lines) / m]


@pytest.mark.parametrize("text", ["", " \n ", "One two two, three!\nOne | 4 -- é.\n\nOne two two, three!", "x" * 500, "A.B C-D 'quoted' (7)\r\nend"])
def test_text_figures_by_definition(text):
    assert cotraining.text_view(text) == pytest.approx(figures(text))


def test_page_figures_by_definition():
    got = cotraining.page_view("en", "src1", 100)
    assert got[:3] == [1.0, math.log(101) / 10, 0.0] and sum(got[3:]) == 2.0
    assert cotraining.page_view(None, None, None)[:3] == [1.0, 0.0, 1.0]


def test_rows_without_identifier_are_in_the_pool(spark):
    docs = spark.createDataFrame([(None, "a b", "en", "s", 3), (None, "c", "en", "s", 1), (1, "d", "en", "s", 1), (2, "e", "de", "s", 1)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    known = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    pool = cotraining.pool_of(docs, known).rows.collect()
    assert len(pool) == 3 and len({r.tie for r in pool}) == 3
