import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.functions import expressions as X
from assayer.operators import marks
from assayer.plans import curation


def page(h=220, w=240):
    rng = np.random.default_rng(0)
    return np.clip(np.linspace(90, 170, w)[None, :, None] + rng.normal(0, 2, (h, w, 1)), 0, 255).repeat(3, 2).astype(np.uint8)


@pytest.mark.parametrize("edge,y", [("top", 2), ("bottom", 208)])
def test_dark_bar(edge, y):
    rgb = page()
    assert marks.edge_marks(rgb) == []
    rgb[y : y + 10, 10:70] = 8
    rgb[y + 3 : y + 7, 14:66:4] = 240
    found = marks.edge_marks(rgb)
    assert [e for e, _ in found] == [edge]
    x0, y0, x1, y1 = found[0][1]
    assert (x0, x1) == (0, 240) and y1 - y0 <= 17 and (y0 == 0 if edge == "top" else y1 == 220)


def test_colour_plate():
    rgb = page()
    rgb[208:216, 180:230] = (220, 20, 30)
    assert [e for e, _ in marks.edge_marks(rgb)] == ["bottom"]
    assert marks.plates(marks.Picture(rgb)) == [(176, 205, 234, 219)]


def test_large_pictures_are_shrunk():
    rgb = page().repeat(10, 0).repeat(10, 1)
    small, scale = marks.shrunk(rgb)
    assert max(small.shape) == 1920 and scale == 0.8 and abs(small.mean() - rgb.mean()) < 1


def test_components_touch_at_corners():
    mask = np.eye(5, dtype=bool)
    mask[0, 4] = True
    assert sorted(marks.components(mask)) == [(0, 0, 5, 5, 5), (4, 0, 5, 1, 1)]


def test_closing_fills_gaps():
    line = np.zeros((15, 20), bool)
    line[7, [5, 9]] = True
    assert marks.closed(line, (7, 5))[7, 5:10].all() and marks.closed(line, (7, 5)).sum() == 5


def test_lines_of_letters():
    letters = [(x, 10, x + 6, 20) for x in range(0, 60, 10)] + [(200, 11, 206, 21), (0, 60, 6, 70)]
    assert sorted(len(x) for x in marks.lines_of(letters)) == [1, 1, 6]


def test_expressions_agree_with_kernels(spark):
    rng = np.random.default_rng(3)
    rows = [(int(a), int(b), int(a + c), int(b + d)) for a, b, c, d in zip(rng.integers(0, 200, 300), rng.integers(0, 150, 300), rng.integers(1, 120, 300), rng.integers(1, 14, 300), strict=True)]
    rows = [r for r in rows if r[2] <= 240 and r[3] <= 160]
    df = spark.createDataFrame(rows, "x0 int, y0 int, x1 int, y1 int")
    box, w, h = F.struct("x0", "y0", "x1", "y1"), F.lit(240), F.lit(160)
    p = marks.Picture(np.zeros((160, 240, 3), np.uint8))
    for r in df.select("*", X.plausible_mark(box, w, h).alias("good"), X.dominant_edge(box, w, h).alias("edge")).collect():
        b = (r.x0, r.y0, r.x1, r.y1)
        assert r.good == p.plausible(b) and r.edge == marks.nearest_edge(b, 240, 160), b


def test_query_finds_planted_bars(spark):
    got = curation.edge_marks(spark, "/root/testdata/sf0.001")
    assert {(r.picture % 3, r.edge) for r in got.collect()} >= {(1, "top"), (2, "bottom")}
    assert got.where("picture % 3 > 0").select("picture").distinct().count() > 300


def lines_step_by_step(letters):
    """One pass over the letters after the other, as long as a pass adds any."""
    todo, out = sorted(letters, key=lambda b: (b[1], b[0])), []
    while todo:
        line = [todo.pop(0)]
        tall, added = max(line[0][3] - line[0][1], 8), True
        while added:
            added, rest = False, []
            for b in todo:
                x0, y0, x1, y1 = (f(g[k] for g in line) for k, f in enumerate((min, min, max, max)))
                gap = max(0, b[0] - x1, x0 - b[2])
                if abs((b[1] + b[3]) / 2 - (y0 + y1) / 2) <= 0.75 * tall and gap <= max(16, 2.4 * tall):
                    line.append(b)
                    added = True
                else:
                    rest.append(b)
            todo = rest
        out.append(line)
    return out


@pytest.mark.parametrize("seed", range(30))
def test_lines_against_passes(seed):
    rng = np.random.default_rng(seed)
    letters = []
    for _ in range(rng.integers(1, 25)):
        x, y, w, h = rng.integers(0, 400), rng.integers(0, 60), rng.integers(3, 14), rng.integers(6, 20)
        letters.append((int(x), int(y), int(x + w), int(y + h)))
    assert marks.lines_of(letters) == lines_step_by_step(letters)


@pytest.mark.parametrize("edge", ["top", "bottom", "left", "right"])
@pytest.mark.parametrize("seed", range(4))
def test_marks_spread_along_their_edge(edge, seed):
    rng = np.random.default_rng(seed)
    p = marks.Picture(np.zeros((200, 260, 3), np.uint8))
    mask = rng.random((200, 260)) < 0.002
    box = {"top": (100, 2, 140, 12), "bottom": (100, 188, 140, 198), "left": (2, 90, 14, 120), "right": (246, 90, 258, 120)}[edge]
    x0, y0, x1, y1 = box
    if edge in ("top", "bottom"):
        held = [x for x in range(max(0, int(x0 - 0.22 * 260)), min(260, int(x1 + 0.22 * 260))) if any(mask[y, x] for y in range(y0, y1))]
        x0, x1 = (min(held) - 3, max(held) + 4) if held else (x0, x1)
        y0, y1 = (0, y1 + 3) if edge == "top" else (y0 - 3, 200)
    else:
        held = [y for y in range(max(0, int(y0 - 0.22 * 200)), min(200, int(y1 + 0.22 * 200))) if any(mask[y, x] for x in range(x0, x1))]
        y0, y1 = (min(held) - 3, max(held) + 4) if held else (y0, y1)
        x0, x1 = (0, x1 + 3) if edge == "left" else (x0 - 3, 260)
    want = (max(0, x0), max(0, y0), min(260, x1), min(200, y1))
    assert marks.spread_along(p, mask, box, edge) == want


def test_pictures_are_drawn_and_sent_in_small_batches(spark):
    import pandas as pd

    pdf = pd.DataFrame({"picture": range(3000), "embedding": [np.linspace(-1, 1, 64)] * 3000})
    rows, most = 0, 0
    for part in curation.drawn([pdf]):
        rows, most = rows + len(part), max(most, int(part["rgb"].map(len).sum()))
    assert rows == 3000 and most <= 8 << 20

    source = spark.range(0, 300, 1, 1).selectExpr("id AS picture", "240 AS w", "220 AS h", "cast(repeat('a', 158400) AS binary) AS rgb")
    old = spark.conf.get(marks.BATCH_SETTING, None)
    spark.conf.unset(marks.BATCH_SETTING)
    try:
        marks.detect(source)
        counted = source.mapInPandas(lambda batches: (pd.DataFrame({"n": [len(b)]}) for b in batches), "n long")
        assert sum(n := [r.n for r in counted.collect()]) == 300 and max(n) * 158_400 <= 8 << 20
    finally:
        spark.conf.set(marks.BATCH_SETTING, old) if old else spark.conf.unset(marks.BATCH_SETTING)
