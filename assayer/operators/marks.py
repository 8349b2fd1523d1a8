"""Marks at the edges of pictures: plates of a rare colour, dark bars with text, lines of small letters, and the strips that
cover them. Kernels work on one picture as an array; pictures are independent rows, in Arrow batches."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions import thresholds as T
from .geometry import BOX, grown_together

#: Shares of the sides, pixel levels and kernel sizes on which results depend.
LEAST_SIDE, MOST_SIDE, STRIP_SHARE, ALONG, GAP = 32, 1920, 0.07, 0.22, 14
PLATE = {"band": 0.085, "rare": 0.025, "saturation": 90, "value": (45, 250), "close": (7, 5), "area": 50, "grow": (4, 3)}
BAR = {"band": 0.085, "dark": 42, "close": (17, 5), "grow": (2, 2), "roi_dark": (55, 0.30), "roi_bright": (140, 0.015), "spread": 16}
LETTER = {"strip": 0.036, "hat": (9, 3), "least": 16, "percentile": 90, "close": (7, 3), "grow": (6, 4), "area": 10}
MASK = {"band": 0.12, "hat": (11, 3), "least": 12, "percentile": 84, "saturation": 75, "value": 40, "dark": 48}

#: Bytes of the batches in which Spark sends pictures to Python workers, and the setting that bounds them; results never depend on it.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"

Rect = tuple[int, int, int, int]


def window(a: np.ndarray, size: tuple[int, int], reduce, fill) -> np.ndarray:
    """A rectangle's maximum or minimum around every pixel, along one axis and then along the other."""
    kx, ky = size
    h, w = a.shape
    padded = np.pad(a, ((ky // 2, ky - 1 - ky // 2), (kx // 2, kx - 1 - kx // 2)), constant_values=fill)
    wide = functools.reduce(reduce, (padded[:, k : k + w] for k in range(kx)))
    return functools.reduce(reduce, (wide[k : k + h] for k in range(ky)))


def closed(mask: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    return window(window(mask, size, np.maximum, False), size, np.minimum, True)


def hats(gray: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """How far thin strokes, dark or bright, stand out."""
    shut = window(window(gray, size, np.maximum, 0), size, np.minimum, 255)
    opened = window(window(gray, size, np.minimum, 255), size, np.maximum, 0)
    return np.minimum(255, shut.astype(int) - opened)


def components(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(x0, y0, x1, y1, area) of 8-connected stretches."""
    from collections import defaultdict

    parent: list[int] = []

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    lines = np.zeros((mask.shape[0], mask.shape[1] + 2), np.int8)
    lines[:, 1:-1] = mask
    ys, xs = np.nonzero(lines[:, 1:] != lines[:, :-1])  # where stretches start and end, in turn
    above, here, pieces, last = [], [], [], -1
    for y, a, b in zip(ys[::2].tolist(), xs[::2].tolist(), xs[1::2].tolist(), strict=True):
        if y != last:
            above, here, last = here if y == last + 1 else [], [], y
        k = len(parent)
        parent.append(k)
        for c, d, other in above:
            if c <= b and a <= d:
                parent[root(k)] = root(other)
        here.append((a, b, k)), pieces.append((a, y, b, k))
    found = defaultdict(list)
    for a, y, b, k in pieces:
        found[root(k)].append((a, y, b))
    return [(min(p[0] for p in ps), ps[0][1], max(p[2] for p in ps), ps[-1][1] + 1, sum(p[2] - p[0] for p in ps)) for ps in found.values()]


class Picture:
    """Derived planes of an RGB array."""

    def __init__(self, rgb: np.ndarray):
        self.rgb, (self.h, self.w) = rgb, rgb.shape[:2]

    @functools.cached_property
    def gray(self) -> np.ndarray:
        return np.rint(self.rgb @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)

    @functools.cached_property
    def channels(self) -> np.ndarray:
        return np.ascontiguousarray(np.moveaxis(self.rgb, 2, 0)).astype(np.int16)

    @functools.cached_property
    def value(self) -> np.ndarray:
        r, g, b = self.channels
        return np.maximum(np.maximum(r, g), b)

    @functools.cached_property
    def range(self) -> np.ndarray:
        """How far the channels of a pixel are apart."""
        r, g, b = self.channels
        return self.value - np.minimum(np.minimum(r, g), b)

    def saturated(self, level: int) -> np.ndarray:
        """Where saturation, 255 * range / value, is above a level; in whole numbers."""
        if not self.range.any():
            return np.zeros((self.h, self.w), bool)
        return 255 * self.range.astype(np.int32) > level * self.value.astype(np.int32)

    @functools.cached_property
    def hue(self) -> np.ndarray:
        """Hue in 0..179."""
        if not self.range.any():
            return np.zeros((self.h, self.w), int)
        r, g, b = self.channels.astype(float)
        top, span = self.value, np.where(self.range > 0, self.range, 1).astype(float)
        hue = np.select([self.range == 0, top == r, top == g], [0, 60 * (g - b) / span, 120 + 60 * (b - r) / span], 240 + 60 * (r - g) / span)
        return np.rint(hue % 360 / 2).astype(int) % 180

    def band(self, share: float) -> np.ndarray:
        inside = np.zeros((self.h, self.w), bool)
        y, x = max(10, int(self.h * share)), max(10, int(self.w * share))
        inside[y : self.h - y, x : self.w - x] = True
        return ~inside

    def clip(self, x0: float, y0: float, x1: float, y1: float) -> Rect:
        x = sorted((min(max(int(x0), 0), self.w), min(max(int(x1), 0), self.w)))
        y = sorted((min(max(int(y0), 0), self.h), min(max(int(y1), 0), self.h)))
        return x[0], y[0], x[1], y[1]

    def grown(self, box, by: tuple[int, int]) -> Rect:
        return self.clip(box[0] - by[0], box[1] - by[1], box[2] + by[0], box[3] + by[1])

    def plausible(self, box: Rect) -> bool:
        """The same test as expressions.plausible_mark."""
        x0, y0, x1, y1 = box
        w, h, bw, bh = self.w, self.h, x1 - x0, y1 - y0
        sized = max(22, int(w * 0.045)) <= bw <= w * 0.66 and max(8, int(h * 0.008)) <= bh <= h * 0.07 and bw * bh <= w * h * 0.06
        mx, my = max(3, int(w * 0.02)), max(3, int(h * 0.02))
        flush = x0 <= mx or y0 <= my or w - x1 <= mx or h - y1 <= my
        cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
        corner = not 0.32 * w < cx < 0.68 * w and not 0.16 * h < cy < 0.84 * h
        bar = bh <= 0.075 * h and bw >= 0.16 * w and (y0 <= 0.03 * h or y1 >= 0.97 * h)
        return sized and flush and (corner or bar)

    def overlaid(self, box: Rect) -> bool:
        """Enough white, black or strong colour for type or a plate."""
        x0, y0, x1, y1 = box
        part = Picture(self.rgb[y0:y1, x0:x1])
        if not part.value.size:
            return False
        pale = 255 * part.range.astype(np.int32) < 90 * np.maximum(part.value, 1).astype(np.int32)
        return ((part.value > 200) & pale).mean() > 0.07 or (part.value < 42).mean() > 0.22 or part.saturated(100).mean() > 0.10


def plates(p: Picture) -> list[Rect]:
    mask = p.saturated(PLATE["saturation"]) & (p.value > PLATE["value"][0]) & (p.value < PLATE["value"][1]) & p.band(PLATE["band"])
    if not mask.any():
        return []
    inner = p.hue[int(p.h * 0.22) : int(p.h * 0.78), int(p.w * 0.22) : int(p.w * 0.78)]
    if not inner.size:
        return []
    rare = np.bincount(inner.ravel(), minlength=180) / inner.size < PLATE["rare"]
    found = [p.grown(c, PLATE["grow"]) for c in components(closed(mask & rare[p.hue], PLATE["close"])) if c[4] >= PLATE["area"]]
    return [b for b in found if p.plausible(b)]


def bars(p: Picture) -> list[Rect]:
    dark = (p.gray < BAR["dark"]) & p.band(BAR["band"])
    if not dark.any():
        return []
    dark = closed(dark, BAR["close"])

    def texted(box: Rect) -> bool:
        roi = p.gray[box[1] : box[3], box[0] : box[2]]
        (low, much), (high, some) = BAR["roi_dark"], BAR["roi_bright"]
        return (roi < low).mean() >= much and (roi > high).mean() >= some and roi.std() >= BAR["spread"]

    return [b for b in (p.grown(c, BAR["grow"]) for c in components(dark)) if p.plausible(b) and texted(b)]


def lines_of(letters: list[Rect]) -> list[list[Rect]]:
    """Letters gathered into lines, each an interval that takes in what is level with it and close to its ends.

    A line starts at the highest letter left. The next letter, in order from the last one taken and then from the top, that
    fits the line as it is by then joins it and widens it, until none fits.
    """
    box = np.array(sorted(letters, key=lambda b: (b[1], b[0])), float).reshape(-1, 4)
    middle, free, out = (box[:, 1] + box[:, 3]) / 2, np.ones(len(box), bool), []
    while free.any():
        at = int(free.argmax())
        tall, (x0, y0, x1, y1), line = max(box[at, 3] - box[at, 1], 8), box[at], []
        while at >= 0:
            free[at] = False
            line.append(at)
            x0, y0, x1, y1 = min(x0, box[at, 0]), min(y0, box[at, 1]), max(x1, box[at, 2]), max(y1, box[at, 3])
            apart = np.maximum(0, np.maximum(box[:, 0] - x1, x0 - box[:, 2]))
            fits = np.flatnonzero(free & (np.abs(middle - (y0 + y1) / 2) <= 0.75 * tall) & (apart <= max(16, 2.4 * tall)))
            at = int(next((k for k in fits if k > at), fits[0])) if len(fits) else -1
        out.append([tuple(int(v) for v in box[k]) for k in line])
    return out


def captions(p: Picture) -> list[Rect]:
    deep, near, out = max(14, int(p.h * LETTER["strip"])), 2 * LETTER["hat"][1], []
    for top, end in ((0, deep), (p.h - deep, p.h)):
        first = max(0, top - near)  # a hat depends on lines no farther away
        strip = hats(p.gray[first : end + near], LETTER["hat"])[top - first : end - first]
        if strip.max(initial=0) < LETTER["least"]:
            continue
        mask = closed(strip >= max(LETTER["least"], int(np.percentile(strip, LETTER["percentile"]))), LETTER["close"])
        low, high = max(5, int(p.h * 0.007)), max(10, int(p.h * 0.032))
        letters = [(a, top + b, c, top + d) for a, b, c, d, n in components(mask) if low <= d - b <= high and 3 <= c - a <= int(p.w * 0.14) and n >= LETTER["area"]]
        for line in lines_of(letters):
            whole = [f(g[k] for g in line) for k, f in enumerate((min, min, max, max))]
            box = p.grown(whole, LETTER["grow"])
            if (len(line) >= 3 or whole[2] - whole[0] >= 0.12 * p.w) and p.overlaid(box) and p.plausible(box):
                out.append(box)
    return out


def mark_mask(p: Picture) -> np.ndarray:
    band, stands = p.band(MASK["band"]), hats(p.gray, MASK["hat"])
    level = int(np.percentile(stands[band], MASK["percentile"])) if band.any() else 0
    strokes = stands >= max(MASK["least"], level)
    return (strokes | (p.saturated(MASK["saturation"]) & (p.value > MASK["value"])) | (p.gray < MASK["dark"])) & band


def nearest_edge(box: Rect, w: int, h: int) -> str:
    """The same choice as expressions.dominant_edge."""
    x0, y0, x1, y1 = box
    cuts = [
        (y0 <= 0.10 * h, -min(w, h - y1), y1, "top"), (y1 >= 0.90 * h, -min(w, y0), h - y0, "bottom"),
        (x0 <= 0.10 * w, -min(h, w - x1), x1, "left"), (x1 >= 0.90 * w, -min(h, x0), w - x0, "right"),
    ]
    near = [(c[1], c[2], k) for k, c in enumerate(cuts) if c[0]]
    if near:
        return cuts[min(near)[2]][3]
    return min(((x0, 0, "left"), (w - x1, 1, "right"), (y0, 2, "top"), (h - y1, 3, "bottom")))[2]


def spread_along(p: Picture, mask: np.ndarray, box: Rect, edge: str) -> Rect:
    """A mark widened along its edge to what the mask holds beside it, and carried to the edge, with a few pixels around."""
    pad = max(3, int(0.003 * max(p.w, p.h)))
    upright = edge in ("left", "right")
    m, length, (a, b), (near, far), side = (
        (mask, p.h, (box[1], box[3]), (box[0], box[2]), p.w) if upright else (mask.T, p.w, (box[0], box[2]), (box[1], box[3]), p.h))
    low, high = max(0, int(a - ALONG * length)), min(length, int(b + ALONG * length))
    held = np.flatnonzero(m[low:high, near:far].any(axis=1))
    if len(held):
        a, b = low + int(held[0]) - pad, low + int(held[-1]) + pad + 1
    near, far = (0, far + pad) if edge in ("top", "left") else (near - pad, side)
    return p.clip(near, a, far, b) if upright else p.clip(a, near, b, far)


def strip_of(p: Picture, box: Rect, edge: str) -> Rect:
    """The band along an edge that covers a mark with a little slack, no deeper than the bound."""
    pad = max(3, int(0.003 * max(p.w, p.h)))
    upright = edge in ("left", "right")
    side = p.w if upright else p.h
    bound = max(16, int(STRIP_SHARE * side))
    near, far = (box[0], box[2]) if upright else (box[1], box[3])
    depth = min(bound, side, (far if edge in ("top", "left") else side - near) + pad)
    a, b = (0, depth) if edge in ("top", "left") else (side - depth, side)
    return (a, 0, b, p.h) if upright else (0, a, p.w, b)


def shrunk(rgb: np.ndarray, most: int = MOST_SIDE) -> tuple[np.ndarray, float]:
    """The picture with its long side at most `most`, by means of areas, and the scale."""
    h, w = rgb.shape[:2]
    scale = min(1.0, most / max(h, w))
    if scale == 1.0:
        return rgb, 1.0
    y, x = (np.arange(max(LEAST_SIDE, int(n * scale))) * n // max(LEAST_SIDE, int(n * scale)) for n in (h, w))
    total = np.add.reduceat(np.add.reduceat(rgb.astype(float), y, 0), x, 1)
    area = np.diff(np.append(y, h))[:, None] * np.diff(np.append(x, w))[None]
    return np.rint(total / area[..., None]).astype(np.uint8), scale


def edge_marks(rgb: np.ndarray) -> list[tuple[str, Rect]]:
    """(edge, strip) of every edge with marks."""
    if min(rgb.shape[:2]) < LEAST_SIDE:
        return []
    small, scale = shrunk(rgb)
    work = Picture(small)
    page = work if scale == 1.0 else Picture(rgb)
    raw = np.array(plates(work) + bars(work) + captions(work), float).reshape(-1, 4)
    merged = [tuple(int(v) for v in b) for b in grown_together(raw, work.w, work.h, GAP, (0.66, STRIP_SHARE))]
    seeds = [b for b in merged if work.plausible(b)]
    mask = mark_mask(page) if seeds else None
    strips: dict[str, Rect] = {}
    for box in (page.clip(*(v / scale for v in b)) for b in seeds):
        edge = nearest_edge(box, page.w, page.h)
        depth = {"top": box[3], "bottom": page.h - box[1], "left": box[2], "right": page.w - box[0]}[edge]
        if depth <= max(16, int(STRIP_SHARE * max(page.w, page.h))) and page.overlaid(box):
            s, t = strip_of(page, spread_along(page, mask, box, edge), edge), strips.get(edge)
            strips[edge] = s if t is None else (min(s[0], t[0]), min(s[1], t[1]), max(s[2], t[2]), max(s[3], t[3]))
    return [(e, strips[e]) for e in T.EDGES if e in strips]


def detect(pictures: DataFrame) -> DataFrame:
    """(picture, edge, x0..y1) of rows (picture, w, h, rgb: bytes row by row)."""

    def run(batches):
        for pdf in batches:
            rows = [
                (p, e, *map(int, s))
                for p, w, h, raw in zip(pdf["picture"], pdf["w"], pdf["h"], pdf["rgb"], strict=True)
                for e, s in edge_marks(np.frombuffer(raw, np.uint8).reshape(h, w, 3))
            ]
            yield pd.DataFrame(rows, columns=["picture", "edge", *BOX])

    spark = pictures.sparkSession
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    kind = dict(pictures.dtypes)["picture"]
    return pictures.select("picture", "w", "h", "rgb").mapInPandas(run, f"picture {kind}, edge string, x0 int, y0 int, x1 int, y1 int")
