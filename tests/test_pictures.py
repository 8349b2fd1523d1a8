"""Pictures: headers, PNG both ways, panels by ten methods, stills from pixels."""

import struct
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assayer.functions import expressions as X
from assayer.operators import geometry, listing, panels, quality, stills
from assayer.plans import curation, studio  # noqa: F401  registers its queries
from assayer.sources import images


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.sampled_from([1, 2, 3, 4]), st.integers(0, 99))
def test_png_round_trip(h, w, n, seed):
    p = np.random.default_rng(seed).integers(0, 256, (h, w, n), np.uint8)
    assert (images.decode_png(images.encode_png(p)) == p).all()


def filtered(p: np.ndarray, kind: int) -> bytes:
    """A PNG whose lines all have one filter, made by the definition, byte by byte."""
    h, w, n = p.shape
    flat = p.reshape(h, w * n).astype(int)
    out = bytearray()
    for y in range(h):
        out.append(kind)
        for x in range(w * n):
            a = flat[y, x - n] if x >= n else 0
            b = flat[y - 1, x] if y else 0
            c = flat[y - 1, x - n] if y and x >= n else 0
            paeth = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            out.append((flat[y, x] - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
    chunk = lambda name, part: len(part).to_bytes(4, "big") + name + part + zlib.crc32(name + part).to_bytes(4, "big")
    colour = {1: 0, 3: 2}[n]
    return images.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes(out))) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize("channels", [1, 3])
def test_png_filters(kind, channels):
    p = np.random.default_rng(kind).integers(0, 256, (6, 7, channels), np.uint8)
    assert (images.decode_png(filtered(p, kind)) == p).all()


def test_broken_pictures(spark):
    good = images.encode_png(np.zeros((3, 4, 3), np.uint8))
    rows = [(1, bytearray(good)), (2, bytearray(good[:40])), (3, None), (4, bytearray(b"hello")), (5, bytearray(good.replace(b"IDAT", b"IDAX")))]
    df = spark.createDataFrame(rows, "id long, content binary")
    got = {r.id: (r.w, r.h, r.channels) for r in images.pixels(df).collect()}
    assert got == {1: (4, 3, 3), 2: (None,) * 3, 3: (None,) * 3, 4: (None,) * 3, 5: (None,) * 3}
    sized = {r.id: (r.format, r.w, r.h, r.error is None) for r in images.sized(df.withColumnRenamed("content", "head")).collect()}
    assert sized[1] == ("png", 4, 3, True) and not sized[3][3] and not sized[4][3]


def test_sides_beyond_what_a_format_has_room_for(spark, tmp_path):
    ids = [*range(9), *range(65_530, 65_546), *range(131_066, 131_080), 3_000_001, 3_000_003, 3_000_003, 3_000_004, 3_000_006, 3_000_007]
    rows = [(k, n % 10) for n, k in enumerate(ids)]
    spark.createDataFrame(rows, "vec_id long, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = curation.QUERIES["image_headers"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(c.sql(curation.SQL["image_headers"]).select(*got.columns).fetchall())


def test_headers():
    assert images.header(b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + ((99) | 49 << 14).to_bytes(4, "little") + b"\0" * 9) == ("webp", 100, 50, 1)
    assert images.header(b"RIFF\0\0\0\0WEBPVP8X" + bytes(8) + (639).to_bytes(3, "little") + (479).to_bytes(3, "little")) == ("webp", 640, 480, 1)
    assert images.header(b"RIFF\0\0\0\0WEBPVP8 " + bytes(10) + struct.pack("<HH", 320 | 1 << 14, 240)) == ("webp", 320, 240, 1)
    with pytest.raises(ValueError):
        images.header(b"\xff\xd8\xff\xda\0\x02")


@pytest.mark.parametrize("turned,want", [(1, "abcdef"), (2, "cbafed"), (3, "fedcba"), (4, "defabc"), (5, "adbecf"), (6, "daebfc"), (7, "fcebda"), (8, "cfbead")])
def test_orientations(turned, want):
    pixels = np.array([list("abc"), list("def")])
    assert "".join(images.upright(pixels, turned).ravel()) == want


def test_files_are_read_by_their_heads(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(images.encode_png(np.zeros((5, 7, 3), np.uint8)))
    (tmp_path / "b.png").write_bytes(b"no picture")
    got = {r.path.rsplit("/", 1)[1]: (r.format, r.w, r.h) for r in images.sizes(spark, str(tmp_path)).collect()}
    assert got == {"a.png": ("png", 7, 5), "b.png": (None, None, None)}


def sheet(background=255.0, content=100.0):
    g = np.full((300, 420), background)
    for y0, x0, y1, x1 in ((0, 0, 145, 205), (0, 215, 145, 420), (155, 0, 300, 130), (155, 140, 300, 270), (155, 280, 300, 420)):
        g[y0:y1, x0:x1] = content
    return g


WANTED = [(0, 0, 205, 145), (215, 0, 420, 145), (0, 155, 130, 300), (140, 155, 270, 300), (280, 155, 420, 300)]


def test_ten_methods():
    light, dark = sheet(), sheet(0.0, 150.0)
    for m in ("auto", "rows", "blobs", "blobs-raw", "gutters-soft"):
        assert panels.cut(light, m) == WANTED, m
    for m in ("auto", "gutters-dark", "rows-dark", "blobs-dark"):
        assert panels.cut(dark, m) == WANTED, m
    assert len(panels.cut(light, "cols")) >= 2 and panels.cut(light, "gutters-dark") != WANTED
    with pytest.raises(ValueError):
        panels.cut(light, "odd")


def test_regions_survive_where_gutters_fail():
    g = np.full((240, 240), 255.0)
    for y, x in ((10, 10), (100, 90), (20, 150), (170, 20)):
        g[y : y + 60, x : x + 60] = 90
    assert sorted(panels.cut(g, "blobs")) == sorted([(10, 10, 70, 70), (90, 100, 150, 160), (150, 20, 210, 80), (20, 170, 80, 230)])


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000))
def test_regions_against_flood_fill(seed):
    rng = np.random.default_rng(seed)
    mask = rng.random((12, 14)) < 0.45
    opened = geometry.opened(mask)
    want = np.zeros_like(mask)  # a cross that fits somewhere covers all its cells
    for y in range(1, 11):
        for x in range(1, 13):
            cells = [(y, x), (y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)]
            if all(mask[c] for c in cells):
                for c in cells:
                    want[c] = True
    assert (opened == want).all()
    seen, found = np.zeros_like(mask), []
    for y, x in zip(*np.nonzero(mask), strict=True):
        if seen[y, x]:
            continue
        todo, cells = [(y, x)], []
        seen[y, x] = True
        while todo:
            a, b = todo.pop()
            cells.append((a, b))
            for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                if 0 <= c < 12 and 0 <= d < 14 and mask[c, d] and not seen[c, d]:
                    seen[c, d] = True
                    todo.append((c, d))
        if len(cells) >= 4:
            ys, xs = zip(*cells, strict=True)
            found.append((min(xs), min(ys), max(xs) + 1, max(ys) + 1))
    assert sorted(geometry.blobs(np.where(mask, 0.0, 255.0), area=4)) == sorted(found)


def test_methods_as_a_table(spark):
    rows = [(k, [[float(v) for v in line] for line in g]) for k, g in enumerate((sheet(), sheet(0.0, 150.0)))]
    got = panels.methods(spark.createDataFrame(rows, "sheet long, gray array<array<double>>"))
    assert got.count() == 20
    kept = listing.distinct_methods(got, ["sheet"])
    assert {r.method for r in kept.where("sheet = 0").collect()} >= {"auto"} and kept.count() < 20
    boxes = got.where("sheet = 1 AND method = 'auto'").first().boxes
    assert boxes == ";".join(",".join(map(str, b)) for b in WANTED)


def test_pieces_previews_and_arguments():
    rgb = np.repeat(sheet()[..., None], 3, 2).astype(np.uint8)
    parts = panels.pieces(rgb, WANTED, panels.Options(pad=5, square=True))
    assert [p.shape for p in parts] == [(210, 210, 3), (210, 210, 3), (150, 150, 3), (150, 150, 3), (150, 150, 3)]
    shown = panels.preview(rgb, WANTED)
    assert (shown[0, :205] == (255, 0, 0)).all() and (shown[144, 0] == (255, 0, 0)).all() and (rgb[0, 0] == 100).all()
    assert panels.arguments(["--least-panel", "20", "--square", "--white", "230"]) == panels.Options(least_panel=20, square=True, white=230.0)
    with pytest.raises(ValueError):
        panels.arguments(["--odd", "1"])
    with pytest.raises(ValueError):
        panels.pieces(rgb, [])


def variance_by_hand(g):
    h, w = g.shape
    at = lambda y, x: float(g[abs(y) if y < h else 2 * h - 2 - y, abs(x) if x < w else 2 * w - 2 - x])
    lap = [at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - 4 * at(y, x) for y in range(h) for x in range(w)]
    mean = sum(lap) / len(lap)
    return sum((v - mean) ** 2 for v in lap) / len(lap)


def test_stills_from_pixels(spark):
    rng = np.random.default_rng(3)
    rgb = rng.integers(0, 256, (90, 120, 3), np.uint8)
    gray = stills.gray_of(rgb)
    assert stills.laplacian_variance(gray) == pytest.approx(variance_by_hand(gray))
    box, eyes = (30, 20, 80, 70), [(45.0, 40.0), (66.0, 41.0)]
    rows = [(1, 120, 90, bytearray(rgb.tobytes()), box, 40.0, eyes), (2, 120, 90, bytearray(rgb.tobytes()), box, None, None)]
    ddl = "id long, w int, h int, rgb binary, face struct<x0:int,y0:int,x1:int,y1:int>, eyes double, places array<struct<x:double,y:double>>"
    got = {r.id: r for r in stills.measured(spark.createDataFrame(rows, ddl)).collect()}
    assert got[1].variance == pytest.approx(variance_by_hand(gray[10:80, 20:90]))
    patches = [gray[40 - 11 : 40 + 11, 45 - 11 : 45 + 11], gray[41 - 11 : 41 + 11, 66 - 11 : 66 + 11]]
    assert got[1].eye_variance == pytest.approx(min(map(variance_by_hand, patches))) and got[2].eye_variance is None
    face = gray[20:70, 30:80].astype(float)
    assert got[1].mean == pytest.approx(face.mean()) and got[1].split == pytest.approx(abs(face[:, :25].mean() - face[:, 25:].mean()) / 255)
    assert got[1].face_share == pytest.approx(50 / 90) and got[1].eyes_share == pytest.approx(40 / 90)


def test_soft_eyes_lower_the_score(spark):
    row = "SELECT 300.0D AS variance, {} AS eye_variance, 150.0D AS eyes, 300.0D AS box_side, 900.0D AS image_side, 128.0D AS mean, 0.0D AS clipped, 0.0D AS split, 0.0D AS yaw, 0.0D AS pitch, 0.5D AS face_share, 0.1D AS eyes_share"
    scores = [quality.scored(spark.sql(row.format(e))).first().score for e in ("CAST(NULL AS double)", "200.0D", "6.0D")]
    assert scores[0] == scores[1] > scores[2]
    assert spark.range(1).select(X.softened(F.lit(300.0), F.lit(18.0))).first()[0] == pytest.approx(150)


def test_shortened_keeps_flat_pictures_and_sides():
    assert (stills.shortened(np.full((600, 512), 7.0)) == 7).all()
    assert stills.shortened(np.zeros((600, 512))).shape == (300, 256) and stills.shortened(np.zeros((200, 900))).shape == (200, 900)
