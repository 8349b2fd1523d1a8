import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from assayer.llm import lattice

PIECES = ["▁", "▁a", "▁ab", "a", "b", "ab", "ba", "c", "é", "bc"]
TOY = lattice.normalised(PIECES, np.arange(1.0, 11.0), np.full(256, 0.01), 2.0)


def segmentations(model, text, at=0):
    """Sum over all ways to cut, one by one."""
    if at == len(text):
        return 1.0
    total = 0.0
    if at:
        total += math.exp(sum(model.bytes[b] for b in text[at].encode())) * segmentations(model, text, at + 1)
    for k, p in enumerate(model.pieces):
        if text.startswith(p, at) and (p[0] != "▁" or at == 0):
            total += math.exp(model.logs[k]) * segmentations(model, text, at + len(p))
    return total


@pytest.mark.parametrize("word", ["a", "ab", "abab", "abcba", "é", "aéb", "▁a", "a▁b", "zz", "\0a"])
def test_marginals(word):
    want = math.log(segmentations(TOY, "▁" + word))
    assert lattice.Solver(TOY).one(word) == pytest.approx(want)
    assert lattice.Solver(TOY).words([word] * 5) == pytest.approx([want] * 5)


def test_pieces_are_a_distribution():
    assert np.exp(TOY.logs).sum() + np.exp(TOY.bytes).sum() + math.exp(TOY.end) == pytest.approx(1)


def test_expected_counts_agree():
    words = ["abab", "abcb", "aébc", "zz▁a", "bbbb"]
    many, one = lattice.Solver(TOY), lattice.Solver(TOY)
    many.words(words, np.arange(1.0, 6.0))
    for k, w in enumerate(words):
        one.one(w, k + 1.0)
    assert many.pieces == pytest.approx(one.pieces) and many.bytes == pytest.approx(one.bytes)
    # Characters are spelt by exactly one piece or byte run each.
    spelt = sum(n * len(p) for n, p in zip(one.pieces, PIECES, strict=True))
    assert spelt <= sum((k + 1) * (len(w) + 1) for k, w in enumerate(words)) + 1e-9


def reference(rows, model):
    learnt = Counter()
    for i, t in rows:
        if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2:
            learnt.update(lattice.words_of(t or ""))
            learnt[None] += 1
    n, v = sum(learnt.values()), len(learnt)
    out = []
    for i, t in rows:
        tokens = [*lattice.words_of(t or ""), None]
        base = sum(math.log10((learnt[w] + 1) / (n + v + 1)) for w in tokens)
        known = sum(learnt[w] > 0 for w in tokens)
        held = zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
        out.append((str(i), held, len(tokens), known, n, pytest.approx(base), pytest.approx(lattice.document_log10(model, t or ""))))
    return sorted(out, key=lambda r: r[:5])


def test_scores(spark, odd, none, monkeypatch):
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(k, f"some more words{k} here é{k} ▁x") for k in range(20, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    models = []
    train = lattice.train
    monkeypatch.setattr(lattice, "train", lambda *a: models.append(train(*a)) or models[-1])
    for rows_broadcast in (100_000, 10):
        monkeypatch.setattr(lattice, "BROADCAST_ROWS", rows_broadcast)
        got = [(str(r[0]), *r[1:]) for r in map(tuple, lattice.lm_scores(df, lattice.default_path()).collect())]
        assert sorted(got, key=lambda r: r[:5]) == reference(rows, models[-1])
    assert lattice.lm_scores(none, lattice.default_path()).count() == 0


def test_held_out_text_is_likelier_than_by_the_files_weights(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text")
    counts = lattice.count_words(rows).cache()
    model = lattice.train(counts, docs.count(), lattice.default_path())
    held = [r.text for r in rows.collect() if lattice.id_crc(r.doc_id) % 7 == 2][:5]
    plain = lattice.load(lattice.default_path())
    assert sum(lattice.document_log10(model, t[:2000]) for t in held) > sum(lattice.document_log10(plain, t[:2000]) for t in held)


def test_long_words_in_bounded_memory():
    word = "abc" * 30_000
    tracemalloc.start()
    got = lattice.Solver(TOY).one(word)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 << 20
    assert got == pytest.approx(float(lattice.Solver(TOY).same_length([word[:3000]])[0]) * 30, rel=0.01)
    assert lattice.Solver(TOY).one(word[:3000]) == pytest.approx(float(lattice.Solver(TOY).same_length([word[:3000]])[0]))
