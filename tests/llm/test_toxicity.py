import math
import random

import pytest

from assayer.llm import toxicity


def invented(rng, toxic):
    words = ["".join(rng.choice(["th", "er", "on", "an", "re", "he", "in"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(30, 400))]
    for _ in range(rng.randint(2, 5) if toxic else 0):
        words.insert(rng.randrange(len(words)), rng.choice(["grunthead", "Foulwit,", "wretchling", "vilesnout."]))
    return " ".join(words)


def test_held_out_accuracy(spark):
    rng = random.Random(4)
    rows = [(k, invented(rng, k % 7 == 0), int(k % 7 == 0)) for k in range(900)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == 900
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert {i for i, *_ in rows if got[i].held_out} == {i for i, *_ in rows if toxicity.id_crc(i) % 5 == 0}
    assert sum(p == y for p, y in held) / len(held) > 0.97
    left = {r.doc_id for r in toxicity.drop_toxic(docs, labels).collect()}
    assert left == {i for i, r in got.items() if not r.predicted}


def test_held_out_labels_are_not_read(spark):
    docs = spark.range(100).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    labels = spark.range(100).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS toxic", "'x' AS text")
    seen = toxicity.labelled(docs, labels).collect()
    assert seen and all(toxicity.id_crc(r.doc_id) % 5 for r in seen)
    assert toxicity.labelled(docs, labels, 7).count() == 7


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (2, 0, 1), (None, 1, 1), (77, 0, 1), (6, 1, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert toxicity.toxicity(none, labels).count() == 0
    assert toxicity.toxicity(odd, labels.where("false")).count() == odd.count()
    assert toxicity.drop_toxic(odd, labels).columns == odd.columns


def test_model_scores_are_probabilities():
    rng = random.Random(8)
    model = toxicity.learn([(k, invented(rng, k % 3 == 0), int(k % 3 == 0)) for k in range(200)])
    assert model.trained and toxicity.score(model, "") < 0.5
    assert toxicity.score(model, "there on grunthead an vilesnout the") > 0.5
    assert toxicity.score(model, "there" * 50_000) == pytest.approx(toxicity.score(model, "there" * 50_000))


def test_lengths_against_plain_compression():
    import zstandard as z

    rng = random.Random(5)
    rows = [(k, invented(rng, k % 3 == 0), int(k % 3 == 0)) for k in range(400)]
    model = toxicity.learn(rows)
    text = "There wretchling, on ThereanIN éa 12 vilesnout. there"
    found = [w.encode() for w in "there wretchling on thereanin éa 12 vilesnout there".split()]
    assert toxicity.windows(text) == found

    def length(content, window):
        p = z.ZstdCompressionParameters(
            window_log=18, chain_log=16, hash_log=16, search_log=6, min_match=4, target_length=32, strategy=z.STRATEGY_LAZY2,
            format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, write_checksum=0)
        d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=p)
        return len(z.ZstdCompressor(dict_data=d, compression_params=p).compress((b" " + window) * 4 + b" "))

    strange = bytes(range(1, 9))
    saved = lambda c, w: min(max(length(c, strange) - 8 + len(w) - length(c, w), 0), 15)
    times = [model.times[(min(len(w), 15) * 16 + saved(model.ordinary, w)) * 16 + saved(model.toxic, w)] for w in found]
    counts = [sum(t >= least for t in times) for least in (1.5, 3, 6, 12)]
    x = [1.0, *(math.log1p(c) for c in counts), math.log1p(len(found)) / 4]
    assert toxicity.score(model, text) == pytest.approx(1 / (1 + math.exp(-sum(a * b for a, b in zip(model.weights, x, strict=True)))))
    assert counts[0] >= 2 and min(counts) >= 1
    assert model.ordinary != model.toxic


def test_the_sample_is_bounded_in_bytes(spark, monkeypatch):
    docs = spark.range(60).selectExpr("id AS doc_id", "repeat('x', 1000) AS text")
    labels = spark.range(60).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS toxic")
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 10_500)
    assert toxicity.labelled(docs, labels).count() == 10


def test_a_huge_text_is_passed_over_alone(spark):
    """The first of the order doesn't fit; all others do, and the last ones that fit are taken too."""
    labels = spark.range(60).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS toxic")
    docs = spark.range(60).selectExpr("id AS doc_id", "repeat('x', 1000) AS text")
    first = toxicity.labelled(docs, labels).first().doc_id
    docs = docs.selectExpr("doc_id", f"CASE WHEN doc_id = {first} THEN repeat('y', 20000) ELSE text END AS text")
    eligible = sum(toxicity.id_crc(i) % 5 != 0 for i in range(60))
    got = toxicity.labelled(docs, labels, sample_bytes=10_500).collect()
    assert len(got) == 10 and first not in {r.doc_id for r in got}
    assert toxicity.labelled(docs, labels, sample_bytes=19_999).count() == 19 and toxicity.labelled(docs, labels, sample_bytes=50_000).count() == 31
    assert toxicity.labelled(docs, labels).count() == eligible


def test_repeated_rows_and_ties_of_the_sample(spark):
    """Rows that repeat a document and its text count once, other texts of it each; the choice doesn't depend on the order of rows."""
    rows = [(7, "a")] * 500 + [(7, "b"), (8, None), (8, ""), (9, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in (7, 8, 9, 9)], "doc_id long, toxic int")
    known = [i for i in (7, 8, 9) if toxicity.id_crc(i) % 5]
    want = {(i, t or "") for i, t in rows if i in known}
    for d in (docs, docs.repartition(7)):
        got = [(r.doc_id, r.text) for r in toxicity.labelled(d, labels).collect()]
        assert len(got) == len(want) and set(got) == want
        assert [(r.doc_id, r.text) for r in toxicity.labelled(d, labels, 2).collect()] == got[:2] or len(known) < 2


def test_those_that_fit():
    assert toxicity.that_fit([5, 100, 3, 3, 1], 10) == [0, 2, 4] and toxicity.that_fit([], 1) == [] and toxicity.that_fit([2], 1) == []
