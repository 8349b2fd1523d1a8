"""Column expressions: scores, bins, boxes, names and paths. All stay in generated code; none is a Python function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import thresholds as T

# Numbers.


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Null stays null, which least and greatest alone would skip."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def sharpness(variance: Column) -> Column:
    import math

    low, high = math.log1p(T.SHARP_LOW), math.log1p(T.SHARP_HIGH)
    return clamp((F.log1p(F.greatest(F.lit(0.0), variance)) - low) / (high - low))


def softened(variance: Column, eyes: Column, least: float = 0.12) -> Column:
    """The variance, lowered where the eyes' is under `least` of it; null eyes change nothing."""
    share = eyes / variance
    return F.when((variance > 0) & (share < least), variance * share / least).otherwise(variance)


def face_size(eyes: Column, box_side: Column, image_side: Column) -> Column:
    by_eyes = clamp((eyes - T.EYES_LOW) / T.EYES_SPAN)
    size = F.when(eyes > 0, by_eyes).otherwise(clamp((box_side - T.BOX_LOW) / T.BOX_SPAN))
    return F.when(image_side < T.SMALL_SIDE, F.least(size, F.lit(T.SMALL_CAP))).otherwise(size)


def light(mean: Column, clipped: Column, split: Column) -> Column:
    bell = F.exp(-0.5 * F.pow((mean - T.LIGHT_MEAN) / T.LIGHT_SIGMA, F.lit(2.0)))
    return clamp(bell * clamp(1 - T.CLIP_WEIGHT * clipped) * clamp(1 - T.SPLIT_WEIGHT * split))


def pose_score(yaw: Column, pitch: Column) -> Column:
    size = lambda x: F.coalesce(F.abs(x), F.lit(0.0))
    both = clamp(1 - size(yaw) / T.YAW_RANGE) * clamp(1 - size(pitch) / T.PITCH_RANGE)
    return F.when(yaw.isNull() & pitch.isNull(), 1.0).otherwise(F.greatest(both, F.lit(T.POSE_FLOOR)))


def landmark_pose(dx: Column, dy: Column, eyes: Column) -> Column:
    """Yaw and pitch from the nose's offset to the middle of the eyes."""
    return F.struct(clamp(90 * dx / eyes, -90, 90).alias("yaw"), clamp(90 * dy / eyes - 61, -90, 90).alias("pitch"))


def scale_bin(face_share: Column, eyes_share: Column) -> Column:
    at = lambda f, e: (face_share >= f) | (eyes_share >= e)
    return F.when(at(T.CLOSE_FACE, T.CLOSE_EYES), "closeup").when(at(T.MEDIUM_FACE, T.MEDIUM_EYES), "medium").otherwise("full")


def pose_bin(yaw: Column) -> Column:
    side = F.when(yaw >= 0, "right").otherwise("left")
    turned = F.when(F.abs(yaw) >= T.PROFILE_YAW, "profile-").otherwise("three-quarter-")
    return F.when(yaw.isNull(), "unknown").when(F.abs(yaw) < T.FRONT_YAW, "front").otherwise(F.concat(turned, side))


def reason(score: Column, sharp: Column, face: Column, lit: Column, pose: Column, mean: Column, clipped: Column, split: Column) -> Column:
    """Why a still scores as it does: the weakest term, the first of these on a tie, and for light what is wrong with it."""
    worst = F.least(sharp, face, lit, pose)
    good = (score >= T.STRONG) & (worst >= T.WEAKEST_TERM)
    weakest = F.when(sharp == worst, "blurry").when(face == worst, "face_too_small").when((lit != worst) & (pose == worst), "profile")
    return (
        F.when(good, "ok").when(weakest.isNotNull(), weakest).when(mean < 90, "dark")
        .when((mean > 170) | ((clipped > 0.08) & (mean >= 128)), "blown").when(split > 0.12, "split_light")
        .otherwise(F.when(mean < 128, "dark").otherwise("blown"))
    )


def band(score: Column) -> Column:
    return F.when(score.isNull(), "skip").when(score >= T.STRONG, "hi").when(score >= T.USABLE, "mid").otherwise("lo")


def count_advice(n: Column, concept: Column) -> Column:
    low, high = F.when(concept == "identity", 8).otherwise(6), F.when(concept == "identity", 20).otherwise(12)
    return F.when((concept != "identity") & (n == 0), "").when((n < low) | (n > high), "warn").otherwise("")


def iou(a: Column, b: Column) -> Column:
    """Of two structs x0, y0, x1, y1."""
    wide = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    high = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    area = lambda c: F.greatest(F.lit(1e-9), (c["x1"] - c["x0"]) * (c["y1"] - c["y0"]))
    return F.when((wide > 0) & (high > 0), wide * high / (area(a) + area(b) - wide * high)).otherwise(0.0)


def dominant_edge(box: Column, w: Column, h: Column) -> Column:
    """The edge whose trimming leaves the longest short side, then the shallowest cut; without any near, the nearest."""
    cut = lambda name, order, near, depth, left: F.when(near, F.struct((-left).alias("left"), depth.alias("depth"), F.lit(order).alias("ord"), F.lit(name).alias("edge")))
    x0, y0, x1, y1 = (box[c] for c in ("x0", "y0", "x1", "y1"))
    options = F.array_compact(F.array(
        cut("top", 0, y0 <= 0.10 * h, y1, F.least(w, h - y1)), cut("bottom", 1, y1 >= 0.90 * h, h - y0, F.least(w, y0)),
        cut("left", 2, x0 <= 0.10 * w, x1, F.least(h, w - x1)), cut("right", 3, x1 >= 0.90 * w, w - x0, F.least(h, x0))))
    far = F.array_min(F.array(*[
        F.struct(d.alias("d"), F.lit(k).alias("ord"), F.lit(e).alias("edge"))
        for k, (e, d) in enumerate((("left", x0), ("right", w - x1), ("top", y0), ("bottom", h - y1)))]))
    return F.coalesce(F.array_min(options)["edge"], far["edge"])


def crop_is_safe(left: Column, top: Column, right: Column, bottom: Column, w: Column, h: Column) -> Column:
    return (right - left >= 32) & (bottom - top >= 32) & ((right - left) * (bottom - top) >= 0.25 * w * h)


def keep_is_full(left: Column, top: Column, right: Column, bottom: Column, w: Column, h: Column, slack: float = 2) -> Column:
    """Within 2 pixels of the border; in shares of the sides, give 0.002."""
    return (left <= slack) & (top <= slack) & (right >= w - slack) & (bottom >= h - slack)


def flush_to_edge(box: Column, w: Column, h: Column) -> Column:
    mx, my = (F.greatest(F.lit(3), F.floor(s * 0.02)) for s in (w, h))
    return (box["x0"] <= mx) | (box["y0"] <= my) | (w - box["x1"] <= mx) | (h - box["y1"] <= my)


def in_corner(box: Column, w: Column, h: Column) -> Column:
    x, y = (box["x0"] + box["x1"]) / 2, (box["y0"] + box["y1"]) / 2
    return ((x <= 0.32 * w) | (x >= 0.68 * w)) & ((y <= 0.16 * h) | (y >= 0.84 * h))


def edge_bar(box: Column, w: Column, h: Column) -> Column:
    flat = (box["y1"] - box["y0"] <= 0.075 * h) & (box["x1"] - box["x0"] >= 0.16 * w)
    return flat & ((box["y0"] <= 0.03 * h) | (box["y1"] >= 0.97 * h))


def plausible_mark(box: Column, w: Column, h: Column) -> Column:
    """Size, area and place of a box fit an edge mark."""
    bw, bh = box["x1"] - box["x0"], box["y1"] - box["y0"]
    large = (bw >= F.greatest(F.lit(22), F.floor(w * 0.045))) & (bh >= F.greatest(F.lit(8), F.floor(h * 0.008)))
    small = (bh <= h * 0.07) & (bw <= w * 0.66) & (bw * bh <= w * h * 0.06)
    return large & small & flush_to_edge(box, w, h) & (in_corner(box, w, h) | edge_bar(box, w, h))


def clamped_box(box: Column, w: Column, h: Column, least: int = 8) -> Column:
    """Corners put in order and inside; null if a side is shorter than `least`."""
    inside = lambda x, top: F.greatest(F.lit(0), F.least(x, top))
    xs = [inside(f(box["x0"], box["x1"]), w) for f in (F.least, F.greatest)]
    ys = [inside(f(box["y0"], box["y1"]), h) for f in (F.least, F.greatest)]
    made = F.struct(xs[0].alias("x0"), ys[0].alias("y0"), xs[1].alias("x1"), ys[1].alias("y1"))
    return F.when((xs[1] - xs[0] >= least) & (ys[1] - ys[0] >= least), made)


def padded(box: Column, by: float, w: float, h: float) -> Column:
    """A box with a margin, inside of w x h."""
    return F.struct(F.greatest(F.lit(0.0), box["x0"] - by).alias("x0"), F.greatest(F.lit(0.0), box["y0"] - by).alias("y0"),
                    F.least(F.lit(w), box["x1"] + by).alias("x1"), F.least(F.lit(h), box["y1"] + by).alias("y1"))


def shifted(box: Column, dx, dy) -> Column:
    return F.struct(*((box[c] + (dx if c[0] == "x" else dy)).alias(c) for c in ("x0", "y0", "x1", "y1")))


def scaled(box: Column, x, y) -> Column:
    """Between pixels and shares of the sides."""
    return F.struct(*((box[c] * (x if c[0] == "x" else y)).alias(c) for c in ("x0", "y0", "x1", "y1")))


def kept_clamped(box: Column, least: float = 0.08) -> Column:
    """A kept rectangle inside of the unit square whose sides are `least` at least."""
    x0, y0 = (F.greatest(F.lit(0.0), F.least(box[c], F.lit(1 - least))) for c in ("x0", "y0"))
    x1, y1 = (F.least(F.lit(1.0), F.greatest(box[c], low + least)) for c, low in (("x1", x0), ("y1", y0)))
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def inverted(gray: Column) -> Column:
    return 255 - gray


def token_count(kind: Column, t: Column, h: Column, w: Column) -> Column:
    """Tokens of a stored latent; null where a dimension isn't a positive whole number."""
    whole = lambda x: x.try_cast("int")
    bad = lambda x: x.isNotNull() & (x != "") & whole(x).isNull()
    n = lambda x, d: F.coalesce(F.nullif(whole(x), F.lit(0)), F.lit(d))
    image = n(t, 1) * F.floor(n(h, 0) / 2) * F.floor(n(w, 0) / 2)
    sound = F.when(n(t, 0) > 0, 2 * n(t, 0))
    still = F.when(~(bad(t) | bad(h) | bad(w)) & (n(h, 0) > 0) & (n(w, 0) > 0), image)
    return F.when(F.coalesce(kind, F.lit("")) == "audio", F.when(~bad(t), sound)).otherwise(still).cast("long")


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def to_linear(x: Column) -> Column:
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def from_linear(x: Column) -> Column:
    return F.when(x <= 0.0031308, x * 12.92).otherwise(1.055 * F.pow(x, F.lit(1 / 2.4)) - 0.055)


def utc_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


# Names and paths.


def slug(x: Column) -> Column:
    body = F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(body, "^-+|-+$", ""), F.lit("")), F.lit("dataset"))


def artefact_name(name: Column, prefix: Column, family: str = "base", version: int = 1, suffix: str = "artefact") -> Column:
    head = F.coalesce(F.nullif(F.regexp_replace(F.trim(prefix), r"(?U)[^\w]+", ""), F.lit("")), F.lit("set"))
    return F.concat(head, F.lit(f"_{family}_"), F.replace(slug(name), F.lit("-"), F.lit("")), F.lit(f"_v{version}_{suffix}"))


def next_version(name: Column, suffix: str = "artefact") -> Column:
    """The number in _v<n>_<suffix> raised by one; names without get version 2."""
    text, pattern = F.trim(name), rf"_v(\d+)_{suffix}$"
    n = F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("long") + 1
    stem = F.regexp_replace(text, rf"(_v\d+)?_{suffix}$", "")
    return F.concat(stem, F.lit("_v"), F.coalesce(n, F.lit(2)).cast("string"), F.lit(f"_{suffix}"))


def safe_name(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(x), r"(?U)[^\w.\-]+", "_"), r"^[._]+|[._]+$", "")


def subfolder(x: Column, reserved: tuple[str, ...] = ("graph_presets", ".git", "__pycache__")) -> Column:
    """A relative folder with / between its parts; null if a part is not allowed."""
    parts = F.filter(F.transform(F.split(F.replace(F.coalesce(x, F.lit("")), F.lit("\\"), F.lit("/")), "/"), lambda p: F.trim(p)), lambda p: (p != "") & (p != "."))
    bad = F.exists(parts, lambda p: (p == "..") | F.lower(p).isin(*reserved) | p.startswith(".") | p.rlike('[<>:"|?*]'))
    return F.when(~bad, F.array_join(parts, "/"))


def folder_below(path: Column, root: str) -> Column:
    """The folder between the first part named `root` and the file; null without such a part."""
    parts = F.split(path, "/")
    at = F.array_position(F.transform(parts, F.lower), root)
    return F.when(at > 0, F.array_join(F.slice(parts, (at + 1).cast("int"), F.greatest(F.lit(0), F.size(parts) - at - 1).cast("int")), "/"))


def url_path(x: Column) -> Column:
    """Every part percent-encoded, spaces as %20, with the unreserved ~ kept and * encoded."""
    quoted = lambda p: F.replace(F.replace(F.replace(F.url_encode(p), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    return F.array_join(F.transform(F.split(x, "/"), quoted), "/")


def moved(x: Column, old: str, new: str) -> Column:
    """A path with the prefix folder `old` replaced; others unchanged."""
    return F.when(x == old, F.lit(new)).when(x.startswith(old + "/"), F.concat(F.lit(new), F.substr(x, F.lit(len(old) + 1)))).otherwise(x)


def in_folder(x: Column, chosen: str, deep: bool = True) -> Column:
    if chosen == "":
        return F.lit(True)
    if chosen == "__root__":
        return F.coalesce(x, F.lit("")) == ""
    return (x == chosen) | x.startswith(chosen + "/") if deep else x == chosen


def suffix(x: Column) -> Column:
    return F.lower(F.regexp_extract(x, r"\.([^./]+)$", 1))


def media_kind(x: Column) -> Column:
    return F.when(suffix(x).isin(*T.IMAGES), "image").when(suffix(x).isin(*T.VIDEOS), "video")


def bytes_text(n: Column) -> Column:
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, "0 B").when(n < 1024, F.format_string("%d B", n))
        .when(n < 1024 * 1024, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.2f MB", n / 1048576))
    )


def preview(x: Column, length: int = 72) -> Column:
    line = F.split(F.trim(F.coalesce(x, F.lit(""))), "\n")[0]
    return F.when(F.length(line) > length, F.concat(F.substring(line, 1, length), F.lit("…"))).otherwise(line)


def html_escaped(x: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(plain), F.lit(entity))
    return x


def one_of(x: Column, allowed: tuple[str, ...], default: str) -> Column:
    """Closed domains: anything else, and null, is the default."""
    return F.when(x.isin(*allowed), x).otherwise(default)


def setting(x: Column, default: Column) -> Column:
    """A whole number given as text; null and empty mean the default."""
    return F.coalesce(F.nullif(x, F.lit("")).try_cast("double").cast("int"), default)
