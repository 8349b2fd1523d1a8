import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from assayer.llm import line_dedup


def brute(rows, least):
    """Every later document against the first holders of its lines, one after another."""
    docs = [(i is None, i or 0, (t or "").split("\n")) for i, t in rows]
    order = sorted(range(len(rows)), key=lambda k: docs[k][:2])
    first = {}
    for k in order:
        for line in docs[k][2]:
            first.setdefault(line, k)
    out = []
    for k, (i, _) in enumerate(rows):
        lines, gone = docs[k][2], set()
        for f in {first[x] for x in lines if x.strip() and first[x] != k}:
            common = lambda a, b: [(p, x, len(x.split())) for p, x in enumerate(a) if x.strip() and x in held]
            held = {x for x in first if sum(x in d[2] for d in docs) > 1}
            gone.update(line_dedup.blocks(common(docs[f][2], lines), common(lines, docs[f][2]), least))
        out.append((i, "\n".join(x for p, x in enumerate(lines) if p not in gone), sorted(gone)))
    return sorted(out, key=str)


def result(spark, rows, least):
    df = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), least)
    return sorted(((r.doc_id, r.text, r.removed) for r in df.collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(6)
    passage = [f"passage line {k} with several words in it" for k in range(6)]
    rows = []
    for k in range(60):
        lines = [f"own {k} {j} {rng.randrange(9)}" for j in range(rng.randrange(1, 9))]
        if rng.random() < 0.5:
            at = rng.randrange(len(lines) + 1)
            lines[at:at] = passage[rng.randrange(3) :]
        lines.insert(rng.randrange(len(lines) + 1), "All rights reserved.")
        rows.append((k, "\n".join(lines)))
    rows += [(90, rows[0][1]), (91, ""), (92, None), (93, "\n\n")]
    for least in (1, 10):
        assert result(spark, rows, least) == brute(rows, least)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=12), st.lists(st.integers(0, 6), max_size=12))
def test_alignment(a, b):
    pairs = line_dedup.align(a, b)
    assert all(a[x] == b[y] for x, y in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    assert len(line_dedup.align(a, a)) == len(a)
    assert {a[x] for x, _ in pairs} >= ({v for v in set(a) & set(b)} if len(set(a) & set(b)) == 1 and a.count(next(iter(set(a) & set(b)))) == b.count(next(iter(set(a) & set(b)))) == 1 else set())


def test_one_copy_of_every_line_stays(spark):
    rows = [(k, "\n".join(f"line {j} some words here to count" for j in range(k % 7, 12))) for k in range(40)]
    left = {x for _, text, _ in result(spark, rows, 1) for x in text.split("\n")}
    assert left >= {x for _, t in rows for x in t.split("\n")}


def all_pairs(rows, least):
    """The places that alignments of every document with every earlier one delete."""
    lists = [[(p, x, len(x.split())) for p, x in enumerate(t.split("\n")) if x.strip()] for _, t in rows]
    return [set().union(*(line_dedup.blocks(a, lists[k], least) for a in lists[:k])) for k in range(len(rows))]


def test_a_block_whose_lines_came_first_elsewhere(spark):
    one, two = "one line of seven words is here", "another line of seven words is here"
    rows = [(1, f"{one}\nown text"), (2, f"own words\n{two}"), (3, f"{one}\n{two}\nthird"), (4, f"fourth\n{one}\n{two}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.removed for r in line_dedup.line_report(df).collect()} == {1: [], 2: [], 3: [], 4: [1, 2]}


def test_nothing_of_all_pairs_is_left(spark):
    rng = random.Random(4)
    lines = [f"line {k} has six words here" for k in range(8)]
    rows = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 7)))) for k in range(60)]
    got = {r.doc_id: set(r.removed) for r in line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (whole, (_, text)) in enumerate(zip(all_pairs(rows, 10), rows, strict=True)):
        assert got[k] >= whole
        mine, earlier = text.split("\n"), ["\n" + t + "\n" for _, t in rows[:k]]
        for p in got[k] - whole:  # moved blocks: an earlier document has the line beside its neighbour
            assert any("\n" + "\n".join(mine[q : q + 2]) + "\n" in t for q in (p - 1, p) if 0 <= q < len(mine) - 1 for t in earlier)


def test_odd_rows(spark, odd, none):
    got = line_dedup.line_report(odd).collect()
    assert len(got) == odd.count()
    assert sorted(r.n_removed > 0 for r in got if r.doc_id == 6 or r.doc_id == 7) == [False, False]
    twice = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")] * 2, "doc_id long, text string")
    assert sorted(r.n_removed for r in line_dedup.line_dedup(twice).collect()) == [0, 1]
    assert line_dedup.line_report(none).count() == 0


def test_a_first_document_of_many_pairs(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"shared line number {k} of some words" for k in range(6)]
    rows = [(0, "\n".join(base))] + [(k, "\n".join([f"own {k}", *base[rng.randrange(3) :]])) for k in range(1, 60)]
    monkeypatch.setattr(line_dedup, "SIDE", 4)
    assert result(spark, rows, 10) == brute(rows, 10)


def test_lines_are_split_once_a_row(spark):
    """A text isn't split again for every line that stays."""
    shared = [f"line {k} of a long passage that both of them have" for k in range(500)]
    rows = [(1, "\n".join(shared)), (2, "\n".join(["own", *shared[:250], "own too", *shared[250:], "last"])), (3, "alone")]
    df = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 10)
    assert not re.search(r"split\([^()]*\)\[", df._jdf.queryExecution().optimizedPlan().toString())  # as split(text)[place]
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in df.collect()} == {
        1: (rows[0][1], 500, 0), 2: ("own\nown too\nlast", 503, 500), 3: ("alone", 1, 0)}
