"""Measurements of stills from pixels: the crop of a face, its sharpness, that of its eyes, and its light."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions import thresholds as T

#: The margin around a face, the short side at which sharpness is measured, an eye's radius, its least patch.
PAD, SHORT, EYE_RADIUS, LEAST_RADIUS, LEAST_PATCH = 0.20, 256, 0.28, 6.0, 8
MEASURED = "variance double, eye_variance double, mean double, clipped double, split double, face_share double, eyes_share double"


def gray_of(rgb: np.ndarray) -> np.ndarray:
    return np.rint(rgb[..., :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def around(pixels: np.ndarray, box, pad: float = PAD) -> np.ndarray:
    """A box with a margin, cut at the border; the whole picture if nothing is left."""
    h, w = pixels.shape[:2]
    dx, dy = round((box[2] - box[0]) * pad), round((box[3] - box[1]) * pad)
    part = pixels[max(0, box[1] - dy) : max(0, min(h, box[3] + dy)), max(0, box[0] - dx) : max(0, min(w, box[2] + dx))]
    return part if part.size else pixels


def shortened(gray: np.ndarray, short: int = SHORT) -> np.ndarray:
    """The short side brought down to `short`, by linear interpolation between the centres of pixels."""
    side = min(gray.shape)
    if side <= short or not side:
        return gray
    for axis in (0, 1):
        n = gray.shape[axis]
        m = max(1, round(n * short / side))
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        share = (at - low).reshape((-1, 1) if axis == 0 else (1, -1))
        a, b = gray.take(low, axis), gray.take(np.minimum(low + 1, n - 1), axis)
        gray = a * (1 - share) + b * share
    return np.rint(gray)


def laplacian_variance(gray: np.ndarray) -> float:
    """Of the four-neighbour Laplacian; borders are reflected without repeating the edge."""
    if not gray.size:
        return 0.0
    g = np.pad(gray.astype(float), [(1, 1) if n > 1 else (0, 0) for n in gray.shape], mode="reflect")
    if g.shape[0] == gray.shape[0]:
        g = np.concatenate([g, g, g])
    if g.shape[1] == gray.shape[1]:
        g = np.concatenate([g, g, g], 1)
    return float((g[1:-1, :-2] + g[1:-1, 2:] + g[:-2, 1:-1] + g[2:, 1:-1] - 4 * g[1:-1, 1:-1]).var())


def eye_patches(gray: np.ndarray, eyes, distance: float) -> list[np.ndarray]:
    radius = max(LEAST_RADIUS, distance * EYE_RADIUS)
    out = []
    for x, y in eyes:
        x0, y0, x1, y1 = max(0, round(x - radius)), max(0, round(y - radius)), min(gray.shape[1], round(x + radius)), min(gray.shape[0], round(y + radius))
        if min(x1 - x0, y1 - y0) >= LEAST_PATCH:
            out.append(gray[y0:y1, x0:x1])
    return out


def light_of(gray: np.ndarray) -> tuple[float, float, float]:
    """Mean, share of pixels that are too dark or too bright, and difference of the halves; an empty patch is all clipped."""
    if not gray.size:
        return 0.0, 1.0, 1.0
    g = gray.astype(float)
    half = max(1, g.shape[1] // 2)
    split = abs(g[:, :half].mean() - g[:, half:].mean()) / 255 if g.shape[1] > 1 else 0.0
    return float(g.mean()), float(((g < T.DARK_PIXEL) | (g > T.BRIGHT_PIXEL)).mean()), float(split)


def measure(rgb: np.ndarray, box, distance: float | None, eyes) -> tuple:
    """MEASURED of one still and its face (box, distance of the eyes, their places, none if unknown)."""
    h, w = rgb.shape[:2]
    gray, crop = gray_of(rgb), gray_of(around(rgb, box))
    face = gray[max(0, box[1]) : max(0, box[3]), max(0, box[0]) : max(0, box[2])]
    patches = eye_patches(gray, eyes, distance) if eyes and distance else []
    sharp = [laplacian_variance(shortened(p)) for p in patches]
    return (
        laplacian_variance(shortened(crop)), min(sharp) if sharp else None, *light_of(face if face.size else crop),
        max(0, box[3] - box[1]) / (h or 1), (distance or 0.0) / (min(h, w) or 1),
    )


def measured(stills: DataFrame) -> DataFrame:
    """Adds MEASURED to rows with w, h, rgb (bytes row by row), face (x0, y0, x1, y1), eyes (distance or null) and places
    (array of x, y structs); quality.scored takes it from there. Faces come from a table, as detectors are external."""
    kept = [c for c in stills.columns if c != "rgb"]

    def run(batches):
        for pdf in batches:
            rows = []
            for w, h, raw, face, eyes, places in zip(*(pdf[c] for c in ("w", "h", "rgb", "face", "eyes", "places")), strict=True):
                rgb = np.frombuffer(raw, np.uint8).reshape(h, w, 3)
                at = [(p["x"], p["y"]) for p in places] if places is not None else []
                box = tuple(int(face[c]) for c in ("x0", "y0", "x1", "y1"))
                rows.append(measure(rgb, box, None if pd.isna(eyes) else float(eyes), at))
            found = pd.DataFrame(rows, columns=[c.split()[0] for c in MEASURED.split(", ")])
            yield pd.concat([pdf[kept].reset_index(drop=True), found], axis=1)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stills.schema if f.name != "rgb")
    return stills.mapInPandas(run, f"{ddl}, {MEASURED}")
