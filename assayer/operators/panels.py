"""Panels of contact sheets by ten methods: gutters (light, soft or dark, rows or columns first) and separate regions."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import geometry as G

Box = tuple[int, int, int, int]
#: The methods in the order in which they are offered, and the level and share of a soft gutter.
METHODS = ("auto", "rows", "cols", "blobs", "blobs-raw", "gutters-soft", "gutters-dark", "rows-dark", "cols-dark", "blobs-dark")
SOFT, BLANK, SLIVER = (220.0, 0.25), 0.85, 0.35


@dataclass(frozen=True)
class Options:
    white: float = 240
    black: float = 40
    share: float = 0.35
    least_gutter: int = 1
    least_panel: int = 48
    least_area: int = 400
    least_panels: int = 2
    mode: str = "auto"
    pad: int = 0
    square: bool = False

    def inverted(self) -> Options:
        """For an inverted sheet: what was at most `black` is a gutter."""
        return replace(self, white=255.0 - self.black)


def without_blank(gray: np.ndarray, boxes: list[Box], white: float) -> list[Box]:
    """Boxes of which no more than a share is white."""
    parts = ((b, gray[b[1] : b[3], b[0] : b[2]]) for b in boxes)
    return [b for b, p in parts if p.size and (p >= white).mean() <= BLANK]


def without_slivers(boxes: list[Box]) -> list[Box]:
    """The same rule as geometry.without_slivers, which works on tables."""
    if len(boxes) < 2:
        return boxes
    b = np.array(boxes, float)
    sides = np.stack([b[:, 2] - b[:, 0], b[:, 3] - b[:, 1]], 1)
    sides = np.concatenate([sides, sides.prod(1, keepdims=True)], 1)
    good = (sides >= SLIVER * np.median(sides, axis=0)).all(1)
    return [x for x, g in zip(boxes, good, strict=True) if g] or boxes


def tight(gray: np.ndarray, box: Box, white: float, least: int) -> Box:
    """The box of the content in a box, unless that is too small."""
    content = gray[box[1] : box[3], box[0] : box[2]] < white
    ys, xs = np.flatnonzero(content.any(1)), np.flatnonzero(content.any(0))
    if not len(ys) or min(xs[-1] - xs[0], ys[-1] - ys[0]) + 1 < least:
        return box
    return box[0] + int(xs[0]), box[1] + int(ys[0]), box[0] + int(xs[-1]) + 1, box[1] + int(ys[-1]) + 1


class Sheet:
    """One sheet at one pair of levels."""

    def __init__(self, gray: np.ndarray, options: Options):
        self.gray, self.o = gray, options
        self.least = max(options.least_panel, min(gray.shape) // 30)
        self.area = max(options.least_area, self.least * self.least // 4)

    def gutters(self, primary: int | None = None, white: float | None = None, share: float | None = None) -> list[Box]:
        white, share = white or self.o.white, share or self.o.share
        boxes = G.split_sheet(self.gray, white, share, self.o.least_gutter, self.least, primary=primary)
        return self.finished(boxes, white)

    def finished(self, boxes: list[Box], white: float) -> list[Box]:
        return [tight(self.gray, b, white, self.least) for b in without_slivers(without_blank(self.gray, boxes, white))]

    def regions(self, opening: bool = True) -> list[Box]:
        return G.blobs(self.gray, self.o.white, area=self.area, opening=opening)

    def separate(self, opening: bool = True) -> list[Box]:
        return [tight(self.gray, b, self.o.white, self.least) for b in without_blank(self.gray, self.regions(opening), self.o.white)]

    def either(self) -> list[Box]:
        """Gutters if they give enough panels, else regions if they do, else whichever there are."""
        by_gutters, by_regions = self.gutters(), self.finished(self.regions(), self.o.white)
        if self.o.mode in ("gutters", "blobs"):
            return by_gutters if self.o.mode == "gutters" else by_regions
        return next((b for b in (by_gutters, by_regions) if len(b) >= self.o.least_panels), by_gutters or by_regions)


def cut(gray: np.ndarray, method: str, options: Options = Options()) -> list[Box]:
    """Panels of a sheet by a method, in reading order."""
    light, dark = Sheet(gray, options), Sheet(255.0 - gray, options.inverted())

    def auto() -> list[Box]:
        first = light.either()
        if len(first) >= options.least_panels:
            return first
        second = dark.either()
        return second if len(second) >= options.least_panels or len(second) > len(first) else first

    ways = {
        "auto": auto, "rows": lambda: light.gutters(0), "cols": lambda: light.gutters(1), "blobs": light.separate,
        "blobs-raw": lambda: light.separate(False), "gutters-soft": lambda: light.gutters(None, *SOFT), "gutters-dark": dark.gutters,
        "rows-dark": lambda: dark.gutters(0), "cols-dark": lambda: dark.gutters(1), "blobs-dark": dark.separate,
    }
    if method not in ways:
        raise ValueError(f"unknown method: {method}")
    return [tuple(int(v) for v in b) for b in G.in_reading_order(np.array(ways[method](), float).reshape(-1, 4))]


def padded(box: Box, w: int, h: int, pad: int) -> Box:
    return max(0, box[0] - pad), max(0, box[1] - pad), min(w, box[2] + pad), min(h, box[3] + pad)


def squared(pixels: np.ndarray, fill: int = 255) -> np.ndarray:
    """Pixels in the middle of a square of the longer side."""
    h, w = pixels.shape[:2]
    side = max(h, w)
    out = np.full((side, side, *pixels.shape[2:]), fill, pixels.dtype)
    y, x = (side - h) // 2, (side - w) // 2
    out[y : y + h, x : x + w] = pixels
    return out


def pieces(pixels: np.ndarray, boxes: list[Box], options: Options = Options()) -> list[np.ndarray]:
    """The pixels of each panel, with `pad` around and squared if asked for; no panel is an error."""
    if not boxes:
        raise ValueError("no panels found")
    h, w = pixels.shape[:2]
    parts = (padded(b, w, h, options.pad) for b in boxes)
    return [squared(p) if options.square else p for p in (pixels[b[1] : b[3], b[0] : b[2]] for b in parts)]


def preview(pixels: np.ndarray, boxes: list[Box], colour=(255, 0, 0)) -> np.ndarray:
    """Outlines of the panels on a copy of the sheet."""
    out = pixels.copy()
    h, w = out.shape[:2]
    for x0, y0, x1, y1 in boxes:
        a, b, c, d = max(0, x0), max(0, y0), min(w - 1, x1 - 1), min(h - 1, y1 - 1)
        out[[b, d], a : c + 1] = colour
        out[b : d + 1, [a, c]] = colour
    return out


def arguments(words: list[str]) -> Options:
    """Options from the words of a command line: --name value, and --square alone."""
    known, given, todo = Options.__dataclass_fields__, {}, list(words)
    while todo:
        name = todo.pop(0).removeprefix("--").replace("-", "_")
        if name not in known:
            raise ValueError(f"unknown option: {name}")
        given[name] = True if name == "square" else type(known[name].default)(todo.pop(0))
    return Options(**given)


def methods(sheets: DataFrame, options: Options = Options(), chosen: tuple[str, ...] = METHODS) -> DataFrame:
    """(sheet, method, ord, count, boxes) of rows (sheet, gray: rows of numbers): the panels by every method, boxes as texts in
    reading order, so that equal results can be told by listing.distinct_methods."""

    def run(batches):
        for pdf in batches:
            rows = []
            for sheet, gray in zip(pdf["sheet"], pdf["gray"], strict=True):
                g = np.stack(gray).astype(float)
                for k, m in enumerate(chosen):
                    found = cut(g, m, options)
                    rows.append((sheet, m, k, len(found), ";".join(",".join(map(str, b)) for b in found)))
            yield pd.DataFrame(rows, columns=["sheet", "method", "ord", "count", "boxes"])

    kind = dict(sheets.dtypes)["sheet"]
    return sheets.select("sheet", "gray").mapInPandas(run, f"sheet {kind}, method string, ord long, count long, boxes string")
