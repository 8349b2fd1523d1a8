"""A quality classifier by co-training two views of a document.

One view sees what the text is like (shares of kinds of characters, repetition of words and lines, lengths of both), the
other only what is known about the page (language, source and declared size). Each is a logistic classifier. Starting
from a bounded sample of labelled rows, in every round each labels all unlabelled rows, and the rows it is surest of,
in the proportions of the classes, go to the other one's training rows. Both are then calibrated on labelled rows that
trained neither, and their calibrated log odds are weighed into the score of every document.

The unlabelled rows stay where they are: cuts come from summed histograms of margins, Newton's steps from summed
gradients and Hessians, and what a row has been told follows from the cuts of the rounds before.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, id_crc, id_crc_col, in_parts, id_text, seeded_hash, text_of
from .toxicity import fit

#: Labels of rows with crc32(doc_id) mod FOLDS = HELD are never read.
FOLDS, HELD = 5, 0
#: At most so many labelled rows are learnt from, those with the smallest seeded hashes.
SAMPLE = 8_000
#: Rounds, and the share of the unlabelled rows that a view hands over in each.
ROUNDS, SHARE = 5, 0.05
#: Buckets of the hashed source and language.
SOURCES, LANGUAGES = 64, 16
#: Bins of margins, so many to each side of 0 and so many to a unit; sums of so many partitions go to the driver at once.
BINS, PER_UNIT, PARTS = 2048, 64, 64


def kinds() -> np.ndarray:
    """Of each byte: 0 lower, 1 upper, 2 digit, 3 white space, 4 mark of a sentence, 5 other ASCII, 6 beyond ASCII."""
    out = np.full(256, 5)
    for k, chars in enumerate((range(97, 123), range(65, 91), range(48, 58), (9, 10, 11, 12, 13, 32), b".,;:!?'\"()-", range(128, 256))):
        out[list(chars)] = k if k < 5 else 6
    return out


KINDS = kinds()


def text_view(text: str) -> list[float]:
    """What a text is like, in figures near one."""
    raw = text.encode()
    n = max(1, len(raw))
    share = np.bincount(KINDS[np.frombuffer(raw, np.uint8)], minlength=7) / n
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    m, k = max(1, len(words)), max(1, len(lines))
    times = Counter(words)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    marks = sum(not w[-1:].isalnum() and w[-1] < 128 for w in words)
    bare = sum(w.strip(b".,;:!?'\"()-|") == b"" for w in words)
    return [
        1.0, *share, len(times) / m, max(times.values(), default=0) / m, again / m, marks / m, bare / m,
        min(3.0, len(raw) / m / 8), math.log1p(m) / 8, len(set(lines)) / k, min(3.0, m / k / 30), sum(x.count(b"|") for x in lines) / m,
    ]


def page_view(lang: str | None, source: str | None, size: int | None) -> list[float]:
    out = [0.0] * (3 + SOURCES + LANGUAGES)
    out[0] = 1.0
    out[1] = math.log1p(max(0, size or 0)) / 10
    out[2] = float(size is None)
    out[3 + zlib.crc32((source or "").encode()) % SOURCES] = 1.0
    out[3 + SOURCES + zlib.crc32((lang or "").encode()) % LANGUAGES] = 1.0
    return out


@dataclass
class Model:
    text: np.ndarray
    page: np.ndarray
    joint: np.ndarray

    def score(self, text: list[float], page: list[float]) -> tuple[float, float, float]:
        """Probabilities by the text, by the page, and by both."""
        a, b = float(np.dot(self.text, text)), float(np.dot(self.page, page))
        return logistic(a), logistic(b), logistic(float(self.joint @ (1.0, a, b)))


def logistic(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def calibrated(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights whose margins are log odds on the rows of x (Platt)."""
    shift, scale = fit(np.stack([np.ones(len(x)), x @ w], axis=1), y, ridge=1e-3)
    out = w * max(scale, 1e-3)
    out[0] += shift
    return out


class Rows:
    """Unlabelled rows at hand: both views, and a number from 0 to 1 for each row that breaks ties."""

    def __init__(self, views: tuple[np.ndarray, np.ndarray]):
        self.views, self.ties = views, np.random.default_rng(43).random(len(views[0]))

    def total(self, f) -> np.ndarray | None:
        """The sum of f(views, ties) over all rows, None without rows."""
        return f(self.views, self.ties) if len(self.ties) else None


class Spread:
    """Unlabelled rows of a DataFrame (tie, both views packed as numbers)."""

    def __init__(self, packed_rows: DataFrame):
        self.rows = checkpointed(packed_rows)
        self.parts = self.rows.rdd.getNumPartitions()

    def total(self, f) -> np.ndarray | None:
        def run(batches):
            out = None
            for b in batches:
                if b.num_rows:
                    one = f(unpacked(b.column("views")), b.column("tie").to_numpy())
                    out = one if out is None else out + one
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["sums"])

        def add(batches):
            found = [np.frombuffer(x.as_py()) for b in batches for x in b.column("sums")]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([np.sum(found, axis=0).tobytes()], pa.binary())], names=["sums"])

        sums = self.rows.mapInArrow(run, "sums binary")
        if self.parts > PARTS:
            sums = sums.repartition(PARTS // 4).mapInArrow(add, "sums binary")
        found = [np.frombuffer(r.sums) for r in sums.collect()]
        return np.sum(found, axis=0) if found else None


def bins(margin: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(margin * PER_UNIT) + BINS, 0, 2 * BINS - 1).astype(int)


def cut(counts: np.ndarray, take: float) -> tuple[int, float]:
    """The first bin that isn't taken whole when `take` rows are, and its share that is."""
    sums = np.cumsum(counts)
    k = int(np.searchsorted(sums, take))
    return (k, (take - sums[k] + counts[k]) / counts[k]) if k < len(counts) and counts[k] else (k, 0.0)


def told(history: list, views: tuple[np.ndarray, np.ndarray], ties: np.ndarray) -> list[np.ndarray]:
    """The pseudo-labels that each view has been given in the rounds so far (nan: none)."""
    given = [np.full(len(ties), np.nan), np.full(len(ties), np.nan)]
    for weights, cuts in history:
        for k in (0, 1):
            at, ((low, low_share), (high, high_share)) = bins(views[k] @ weights[k]), cuts[k]
            free, other = np.isnan(given[1 - k]), 2 * BINS - 1 - at  # the bin from above
            given[1 - k][free & ((at < low) | (at == low) & (ties < low_share))] = 0.0
            given[1 - k][free & ((other < high) | (other == high) & (ties < high_share))] = 1.0
    return given


def handed_over(pool, history: list, weights: list, rows: float, positive: float) -> list:
    """For each view, the cuts from below and above between which its rows are too unsure to hand over."""

    def count(views, ties):
        given = told(history, views, ties)
        at = [bins(views[k] @ weights[k])[np.isnan(given[1 - k])] for k in (0, 1)]
        return np.concatenate([np.bincount(x, minlength=2 * BINS) for x in at]).astype(float)

    counts = pool.total(count).reshape(2, 2 * BINS)
    take = SHARE * rows
    return [(cut(c[:BINS], take * (1 - positive)), cut(c[: BINS - 1 : -1], take * positive)) for c in counts]


def fit_all(pool, history: list, views: list, y: np.ndarray, rounds: int = 30, ridge: float = 0.05) -> list:
    """`fit` of both views on labelled rows and on what each has been told, by Newton's method over summed derivatives."""

    def derivatives(x, y, w):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        return np.concatenate([x.T @ (y - p), ((x * (p * (1 - p))[:, None]).T @ x).ravel()])

    weights = [np.zeros(v.shape[1]) for v in views]
    for _ in range(rounds):
        now = [w.copy() for w in weights]

        def both(free, ties, now=now):
            given = [(v, g, ~np.isnan(g)) for v, g in zip(free, told(history, free, ties), strict=True)]
            return np.concatenate([derivatives(v[has], g[has], w) for (v, g, has), w in zip(given, now, strict=True)])

        sums, largest, at = pool.total(both), 0.0, 0
        for k, w in enumerate(weights):
            n = len(w)
            one = derivatives(views[k], y, now[k]) + sums[at : at + n + n * n]
            at += n + n * n
            penalty = np.full(n, ridge)
            penalty[0] = 1e-6
            step = np.linalg.solve(one[n:].reshape(n, n) + np.diag(penalty), one[:n] - penalty * w)
            w += step
            largest = max(largest, np.abs(step).max())
        if largest < 1e-8:
            break
    return weights


def co_train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, apart: np.ndarray, free) -> Model:
    """views and y: labelled rows; apart: which of them only calibrate; free: unlabelled rows (views at hand, or Spread)."""
    if len(set(y)) < 2:
        known = float(y[0]) if len(y) else 0.0
        rest = lambda v: np.append(60.0 * known - 30.0, np.zeros(v.shape[1] - 1))
        return Model(rest(views[0]), rest(views[1]), np.array([0.0, 1.0, 0.0]))
    taught = ~apart if apart.any() else np.ones(len(y), bool)
    check = apart if apart.any() else taught
    weights = [fit(v[taught], y[taught]) for v in views]
    positive = y[taught].mean()
    pool, history = Rows(free) if isinstance(free, tuple) else free, []
    rows = pool.total(lambda _, ties: np.array([float(len(ties))]))
    for _ in range(ROUNDS if rows is not None else 0):
        history.append((weights, handed_over(pool, history, weights, rows[0], positive)))
        weights = fit_all(pool, history, [v[taught] for v in views], y[taught])
    text, page = (calibrated(w, v[check], y[check]) for w, v in zip(weights, views, strict=True))
    margins = np.stack([np.ones(check.sum()), views[0][check] @ text, views[1][check] @ page], axis=1)
    return Model(text, page, fit(margins, y[check], ridge=1.0))


def packed(text: list[float], page: list[float]) -> bytes:
    """Both views as numbers, of the page view's buckets only the places of the ones."""
    return np.array([*page[1:3], page.index(1.0, 3), page.index(1.0, 3 + SOURCES), *text]).tobytes()


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(b"".join(column.to_pylist())).reshape(len(column), -1)
    page = np.zeros((len(rows), 3 + SOURCES + LANGUAGES))
    page[:, 0], page[:, 1:3] = 1.0, rows[:, :2]
    for k in (2, 3):
        page[np.arange(len(rows)), rows[:, k].astype(int)] = 1.0
    return rows[:, 4:], page


def pool_of(docs: DataFrame, known: DataFrame) -> Spread:
    """All rows of documents that have no label; those without identifier have none."""

    def run(batches):
        for b in in_parts(batches):
            pages = zip(*(b.column(c).to_pylist() for c in ("lang", "source", "n_chars")), strict=True)
            out = [packed(text_view(t.as_py()), page_view(*p)) for t, p in zip(b.column("text"), pages, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "views"])

    rows = docs.mapInArrow(run, "doc_id long, views binary").join(known.select("doc_id"), "doc_id", "left_anti")
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5("views")))
    return Spread(rows.select((seeded_hash(43, own) / float(1 << 60)).alias("tie"), "views"))


def viewed(docs: DataFrame, keep: str | None) -> DataFrame:
    """doc_id, the label if `keep` names it, and both views."""
    extra = [keep] if keep else []

    def run(batches):
        for b in batches:
            text = [text_view(t.as_py()) for t in b.column("text")]
            page = [page_view(*x) for x in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "n_chars")), strict=True)]
            columns = [b.column("doc_id"), *(b.column(c) for c in extra), pa.array(text, pa.list_(pa.float64())), pa.array(page, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *extra, "text", "page"])

    return docs.mapInArrow(run, "doc_id long, " + "".join(f"{c} int, " for c in extra) + "text array<double>, page array<double>")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    order = seeded_hash(43, id_text())
    chosen = known.where(id_crc_col() % FOLDS != HELD).orderBy(order, "doc_id").limit(sample)
    taught = viewed(docs.join(F.broadcast(chosen), "doc_id"), "quality").orderBy(order, "doc_id", "text", "page").limit(sample)  # numbers, no texts
    rows = sorted(taught.collect(), key=lambda r: (r.doc_id, r.text))
    apart = np.array([id_crc(r.doc_id) // FOLDS % 4 == 0 for r in rows], bool)
    y = np.array([float(r.quality > 0) for r in rows])
    if len(set(y[apart])) < 2 or len(set(y[~apart])) < 2:
        apart[:] = False
    shape = lambda rs, c, n: np.array([r[c] for r in rs]).reshape(len(rs), n)
    n, m = len(text_view("")), len(page_view(None, None, None))
    return co_train((shape(rows, "text", n), shape(rows, "page", m)), y, apart, pool_of(docs, known) if len(set(y)) > 1 else None)


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, text_score, page_score, score (0 to 1, higher: better), predicted of every row of documents.

    Null texts count as empty, and null languages, sources and sizes are values of their own. Without labels of both
    classes every score is the class there is (0 without any). Repeated rows are scored alike.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    shared = spark.sparkContext.broadcast(train(rows, labels, sample))

    def run(batches):
        for b in in_parts(batches):
            pages = zip(*(b.column(c).to_pylist() for c in ("lang", "source", "n_chars")), strict=True)
            scores = [shared.value.score(text_view(t.as_py()), page_view(*p)) for t, p in zip(b.column("text"), pages, strict=True)]
            held = [id_crc(i) % FOLDS == HELD for i in b.column("doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array(held, pa.bool_()), *(pa.array([s[k] for s in scores], pa.float64()) for k in range(3)),
                pa.array([int(s[2] >= 0.5) for s in scores], pa.int32()),
            ], names=["doc_id", "held_out", "text_score", "page_score", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, text_score double, page_score double, score double, predicted int")
