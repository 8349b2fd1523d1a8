"""The decoder against streams that a small encoder for every feature writes."""

import base64
import hashlib
import zlib

import numpy as np
import pytest

from assayer.llm import webp
from assayer.llm.webp import LENGTHS, LITERALS, Writer


def put_code(w, lengths):
    """A normal code whose code-length code has 16 symbols of 4 bits, without repeats."""
    w.put(0, 1), w.put(15, 4)
    for k in webp.LENGTH_ORDER:
        w.put(4 if k < 16 else 0, 3)
    w.put(0, 1)
    for n in lengths:
        for bit in f"{n:04b}":
            w.put(int(bit), 1)
    codes, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        codes[s], last, code = f"{code:0{n}b}", n, code + 1
    return codes if len(codes) > 1 else dict.fromkeys(codes, "")


def skewed(symbols, alphabet):
    """A complete code with lengths 1, 2, 3, ... for the first eight and equal ones for the rest."""
    lengths = [0] * alphabet
    symbols = list(symbols)
    depth = 0
    while len(symbols) > 1 and depth < 3:
        depth += 1
        lengths[symbols.pop(0)] = depth
    n = (len(symbols) - 1).bit_length()
    short = (1 << n) - len(symbols)
    for k, s in enumerate(symbols):
        lengths[s] = depth + n - (k < short) if len(symbols) > 1 else max(1, depth)
    return lengths


def put(w, codes, symbol):
    for bit in codes[symbol]:
        w.put(int(bit), 1)


def amount(value):
    """Prefix code, number of extra bits and their value of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    n = v.bit_length() - 1
    half = v >> (n - 1) & 1
    return 2 * n + half, n - 1, v - ((2 + half) << (n - 1))


def put_image(w, image, main, cache_bits=0, side=0, references=True):
    h, width, _ = image.shape
    flat = [int(a) << 24 | int(r) << 16 | int(g) << 8 | int(b) for r, g, b, a in image.reshape(-1, 4)]
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    groups = 1
    if main:
        w.put(1 if side else 0, 1)
        if side:
            w.put(side - 2, 3)
            mh, mw = -(-h >> side), -(-width >> side)
            meta = np.zeros((mh, mw, 4), np.uint8)
            meta[:, :, 1] = np.arange(mh * mw).reshape(mh, mw) % 2
            put_image(w, meta, False)
            groups = 2
    n = LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0)
    sets = []
    for g in range(groups):
        order = np.random.default_rng(g).permutation
        sets.append([put_code(w, skewed(order(k), k)) for k in (n, 256, 256, 256, 40)])
    cache = {}
    at = 0
    while at < len(flat):
        y, x = divmod(at, width)
        green, red, blue, alpha, distance = sets[int(meta[y >> side, x >> side, 1]) if groups == 2 else 0]
        run = 0
        for back in (1, 2, width, width + 1, 150) if references else ():
            k = 0
            while back <= at and at + k < len(flat) and flat[at + k] == flat[at + k - back]:
                k += 1
            if k > run:
                run, best = k, back
        key = (webp.CACHE_FACTOR * flat[at] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        if run >= 3:
            code, extra, rest = amount(run)
            put(w, green, LITERALS + code), w.put(rest, extra)
            short = [k + 1 for k, (dx, dy) in enumerate(webp.near()) if max(1, dx + dy * width) == best]
            code, extra, rest = amount(short[-1] if short else best + 120)
            put(w, distance, code), w.put(rest, extra)
        elif cache_bits and cache.get(key) == flat[at]:
            run = 1
            put(w, green, LITERALS + LENGTHS + key)
        else:
            run = 1
            a, r, g, b = (flat[at] >> s & 255 for s in (24, 16, 8, 0))
            put(w, green, g), put(w, red, r), put(w, blue, b), put(w, alpha, a)
        for p in flat[at : at + run]:
            if cache_bits:
                cache[(webp.CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
        at += run


def stream(image, transforms=(), **options):
    h, width, _ = image.shape
    w = Writer()
    w.put(webp.SIGNATURE, 8), w.put(width - 1, 14), w.put(h - 1, 14), w.put(1, 1), w.put(0, 3)
    rng = np.random.default_rng(9)
    image = image.copy()
    for kind in transforms:
        w.put(1, 1), w.put(kind, 2)
        if kind == webp.PREDICTOR:
            w.put(0, 3)
            data = np.zeros((-(-h >> 2), -(-image.shape[1] >> 2), 4), np.uint8)
            data[:, :, 1] = np.arange(data[:, :, 1].size).reshape(data.shape[:2]) % 16
            put_image(w, data, False)
            whole, out = image.astype(int), image.copy()
            for y in range(h):
                for x in range(image.shape[1]):
                    p = webp.predicted(webp.predictor_mode(data, 2, x, y), *webp.neighbours(whole, x, y))
                    out[y, x] = (whole[y, x] - p) & 255
            image = out
        elif kind == webp.CROSS_COLOUR:
            w.put(1, 3)
            data = rng.integers(0, 256, (-(-h >> 3), -(-image.shape[1] >> 3), 4), np.uint8)
            put_image(w, data, False)
            f = webp.spread(data, 3, image.shape)
            out = image.astype(int)
            shift = webp.colour_shift
            out[:, :, 2] = (out[:, :, 2] - shift(f[:, :, 1], image[:, :, 1]) - shift(f[:, :, 0], image[:, :, 0])) & 255
            out[:, :, 0] = (out[:, :, 0] - shift(f[:, :, 2], image[:, :, 1])) & 255
            image = out.astype(np.uint8)
        elif kind == webp.SUBTRACT_GREEN:
            image[:, :, 0] -= image[:, :, 1]
            image[:, :, 2] -= image[:, :, 1]
        else:
            colours, index = np.unique(image.reshape(-1, 4), axis=0, return_inverse=True)
            w.put(len(colours) - 1, 8)
            put_image(w, np.diff(colours, axis=0, prepend=np.zeros((1, 4), np.uint8))[None], False)
            share = webp.palette_bits(len(colours))
            per, each = 1 << share, 8 >> share
            index = np.pad(index.reshape(h, width), ((0, 0), (0, -width % per)))
            packed = (index.reshape(h, -1, per) << (each * np.arange(per))).sum(2)
            image = np.zeros((*packed.shape, 4), np.uint8)
            image[:, :, 1], image[:, :, 3] = packed, 255
    w.put(0, 1)
    put_image(w, image, True, **options)
    return w.bytes()


def picture(h, width, colours=None, seed=1):
    rng = np.random.default_rng(seed)
    if colours:
        table = rng.integers(0, 256, (colours, 4), np.uint8)
        return table[rng.integers(0, colours, (h, width))]
    image = rng.integers(0, 256, (h, width, 4), np.uint8)
    image[h // 3 : h // 2] = image[0, 0]
    image[h // 2 :, : width // 2] = image[: h - h // 2, : width // 2]
    return image


@pytest.mark.parametrize("transforms", [(), (0,), (1,), (2,), (2, 0), (0, 1), (0, 1, 2), (1, 0)])
@pytest.mark.parametrize("options", [{}, {"cache_bits": 4}, {"side": 2}, {"cache_bits": 9, "side": 3}])
def test_every_feature(transforms, options):
    image = picture(19, 23)
    assert (webp.decode_stream(stream(image, transforms, **options)) == image).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 200])
def test_palettes(colours):
    image = picture(11, 21, colours)
    assert (webp.decode_stream(stream(image, (3,), cache_bits=3)) == image).all()
    assert (webp.decode_stream(stream(image, (3, 0))) == image).all()


def test_known_file():
    one = webp.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA=="))
    assert [x.shape for x in one] == [(1, 1, 4)]


def test_neighbours_of_short_distances():
    assert webp.near()[:12] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2)]
    assert len(webp.near()) == 120 and webp.near()[-1] == (8, 7)


@pytest.mark.parametrize("payload", [b"", b"a", b"abc" * 500, bytes(range(256)) * 20, b"ab" * 5_000_000], ids=len)
def test_store_and_load(payload):
    back = webp.load(webp.store(payload)).tobytes()
    assert back[: len(payload)] == payload and not back[len(payload) :].strip(b"\xff") and len(back) % 576 == 0 and back


TEXTS = [
    b"", b"a", b"abc" * 500, bytes(range(256)) * 20, b"the cat sat on the mat, and the dog lay by the door. " * 90,
    np.random.default_rng(3).integers(97, 123, 30_000, np.uint8).tobytes(), np.random.default_rng(4).bytes(9_000),
    np.repeat(np.random.default_rng(5).integers(0, 256, 3_000, np.uint8), 3).tobytes(),
    (np.arange(20_000) // 3 % 251).astype(np.uint8).tobytes(), np.random.default_rng(6).permutation(256).astype(np.uint8).tobytes() * 9,
]


@pytest.mark.parametrize("payload", TEXTS, ids=lambda x: f"{len(x)}-{zlib.crc32(x)}")
def test_compressed_streams(payload):
    media = webp.store(payload, webp.compress_stream)
    back = webp.load(media, arrays=False).tobytes()
    assert back[: len(payload)] == payload and not back[len(payload) :].strip(b"\xff")


def test_query_compresses_and_reads_by_symbols(spark, monkeypatch):
    text = "the cat sat on the mat, and the dog lay by the door. " * 90
    row = webp.media_columns(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.media_bytes < len(text) / 10 < len(webp.store(text.encode()))
    monkeypatch.setattr(webp, "read_even", None)  # the array path isn't there
    assert webp.load(webp.store(text.encode(), webp.compress_stream), arrays=False).tobytes().startswith(text.encode())


def test_broken_files():
    good = webp.store(b"some text " * 300)
    for bad in (b"RIFFxxxx", good[:40], good[:12] + b"VP8L" + b"\x04\x00\x00\x00" + b"\x2e\x00\x00\x00", good[:900]):
        with pytest.raises((ValueError, IndexError)):
            webp.load(bad)


def test_columns(spark, odd, none):
    rows = webp.media_columns(odd).collect()
    assert len(rows) == odd.count()
    texts = {}
    for r in odd.collect():
        texts.setdefault(r.doc_id, []).append((r.text or "").encode())
    for r in rows:
        fit = [t for t in texts[r.doc_id] if len(t) == r.n_bytes]
        payload = fit[0].ljust(max(1, -(-len(fit[0]) // 576)) * 576, b"\xff")
        assert (r.payload_bytes, r.payload_sha256) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
    assert webp.media_columns(none).count() == 0
    pixels = webp.read_media(webp.store_media(odd)).collect()
    assert len(pixels) == len(rows) and all(p.error is None for p in pixels)
    broken = spark.createDataFrame([(1, b"RIFF"), (2, None)], "doc_id long, media binary")
    assert [(r.doc_id, r.pixels) for r in webp.read_media(broken).collect()] == [(1, None)]


def test_side_by_side_equals_one_by_one():
    """With copies that reach into themselves, caches of each size, palettes, several files and enough images to be read abreast."""
    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(97, 123, n, np.uint8)) for n in rng.integers(2, 9, 400)]
    texts = [b" ".join(words[k] for k in rng.integers(0, 400, n)) for n in rng.integers(1, 900, 90)]
    texts += [b"", b"a" * 5000, b"abcdef" * 3000, b"\x00\x01" * 700, rng.integers(0, 256, 9000, np.uint8).tobytes(), b"x" * (webp.BLOCK * (webp.MOST_SIDE + 3))]
    texts += [b"abc" * 200 + t for t in texts[:60]]
    media = [webp.store(t, webp.compress_stream) for t in texts]
    asked = []
    single = webp.read_single
    try:
        webp.read_single = lambda *a: asked.append(len(a)) or single(*a)
        found = webp.load_all(media)
    finally:
        webp.read_single = single
    assert len(asked) < len(media)  # most are read side by side
    for text, file, pixels in zip(texts, media, found, strict=True):
        assert (pixels == webp.load(file, arrays=False)).all() and pixels.tobytes()[: len(text)] == text


@pytest.mark.parametrize("cut", [40, 200])
def test_broken_streams_side_by_side(cut):
    good = webp.compress_stream(np.random.default_rng(1).integers(0, 40, (30, 192, 3), np.uint8))
    with pytest.raises(ValueError):
        webp.abreast([webp.decoding(good, False) for _ in range(40)] + [webp.decoding(good[:-cut], False)])


def test_streams_together_equal_those_alone():
    """Of palettes, images of one pixel row, predicted ones and long ones with 64-bit keys, in several batches."""
    rng = np.random.default_rng(7)
    images = [x for t in TEXTS for x in webp.pieces(t)]
    images += [rng.integers(0, k + 2, (int(h), 192, 3), np.uint8) for k, h in enumerate(rng.integers(1, 9, 150))]
    images += [np.cumsum(rng.integers(0, 3, (12, 192, 3)), axis, np.uint8) for axis in (0, 1)] + [rng.integers(97, 123, (90, 192, 3), np.uint8)]
    streams = webp.compress_streams(images)
    for k, (image, data) in enumerate(zip(images, streams, strict=True)):
        assert (webp.decode_stream(data, False)[:, :, :3] == image).all()
        assert k % 5 or data == webp.compress_stream(image)


def test_code_lengths_are_bounded():
    counts = [1, 1]
    while len(counts) < 30:
        counts.append(counts[-1] + counts[-2])  # as deep as a code can be
    owner = np.array([0] * 30 + [1] * 2 + [2] * 30)
    lengths = webp.code_lengths(owner, np.array(counts + [5, 9] + [3] * 30), 15)
    assert lengths[:30].max() == 15 and lengths[30:32].tolist() == [1, 1] and set(lengths[32:].tolist()) == {4, 5}
    assert np.bincount(owner, 0.5**lengths).tolist() == [1, 1, 1]


def test_codes_are_read_side_by_side(monkeypatch):
    """Those of streams with several groups, palettes and other encoders' codes too; only single symbols are read alone."""
    plain = [webp.compress_stream(np.random.default_rng(k).integers(0, 9 + k, (4, 192, 3), np.uint8)) for k in range(40)]
    other = [stream(picture(9, 13, c), [t], cache_bits=b, side=s) for c, t, b, s in ((None, 2, 4, 2), (5, 3, 0, 0), (None, 0, 0, 3))]
    alone = [webp.decode_stream(x, False) for x in plain + other]
    asked, one = [], webp.read_code
    monkeypatch.setattr(webp, "read_code", lambda bits, n: asked.append(bits.peek() & 1) or one(bits, n))
    found = webp.abreast([webp.decoding(x, False) for x in plain])
    assert asked and all(asked)
    found += webp.abreast([webp.decoding(x, False) for x in other])
    assert all((a == b).all() for a, b in zip(alone, found, strict=True))


def test_copies_beyond_the_largest_distance():
    rng = np.random.default_rng(8)
    image = rng.integers(97, 123, (6000, 192, 3), np.uint8)
    image[5700:5800] = image[10:110]  # 1,092,480 pixels before
    image[5900:] = image[600:700]
    assert (webp.decode_stream(webp.compress_stream(image), False)[:, :, :3] == image).all()
