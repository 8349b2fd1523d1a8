"""Toxicity by compression distance: the lengths that two separate zstandard dictionaries give to windows of a text.

Training works on a bounded, documented sample of labelled rows. A window is a run of letters and digits, measured
REPEATS times over, so that a frame's fixed cost doesn't hide what a dictionary explains. zstandard trains the ordinary
dictionary on windows of ordinary documents. The content of the toxic one are windows of toxic documents, chosen by contrast: as
most of a toxic document is ordinary prose too, only windows that come in several toxic documents and, by their share, more
often than in ordinary ones make it up, most frequent last. (Where zstandard chooses the content, with or without that contrast,
most of it is prose, and most toxic documents pass; the README has figures.)

Thresholds are calibrated on the joint histogram of a window's size and of the bytes that either dictionary saves: each
cell tells how many times as often toxic documents fill it as ordinary ones do. For that, the windows of one half of the
toxic documents are measured by a dictionary of the other half, and those of ordinary documents that trained nothing.
Of a text, the numbers of windows whose cells reach 1.5, 3, 6 and 12 times enter a logistic function, fitted on labelled
rows that trained no dictionary, if there are enough of them.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc, id_crc_col, id_text, bounded_batches, frugal, kept_for, seeded_hash, text_of

#: Labels of rows with crc32(doc_id) mod FOLDS = HELD are never read.
FOLDS, HELD = 5, 0
#: At most so many labelled rows, and bytes of their texts, are learnt from, those with the smallest seeded hash.
SAMPLE, SAMPLE_BYTES = 8_000, 32 << 20
#: How often a window is repeated when it is measured, the sizes of the dictionaries, and how deep zstandard searches.
REPEATS, ORDINARY_BYTES, TOXIC_BYTES, SEARCH = 4, 110 << 10, 4 << 10, 6
#: Documents of a half that have a window, and how much larger their share has to be, for it to train the toxic dictionary.
RECURRING, CONTRAST = 2, 6
#: Surplus from which windows are counted; sizes and savings from which cells aren't told apart.
GAINS, MOST = (1.5, 3, 6, 12), 16
#: Rows of each class that a separate calibration takes.
APART = 30
#: Windows whose lengths a worker remembers, and the longest of them.
REMEMBERED, LONGEST = 100_000, 32

WINDOW = re.compile(rb"[0-9a-z\x80-\xff]+")


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    times: np.ndarray
    weights: tuple[float, ...]
    trained: bool = True


def windows(text: str) -> list[bytes]:
    return WINDOW.findall(text.encode().lower())


def coder(content: bytes):
    """The length that a dictionary gives to a window."""
    import zstandard as z

    d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
    p = z.ZstdCompressionParameters(
        window_log=18, chain_log=16, hash_log=16, search_log=SEARCH, min_match=4, target_length=32, strategy=z.STRATEGY_LAZY2,
        format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, write_checksum=0)
    if content:
        d.precompute_compress(compression_params=p)
    compress = z.ZstdCompressor(dict_data=d, compression_params=p).compress
    return lambda window: len(compress((b" " + window) * REPEATS + b" "))


class Distance:
    """How much likelier the lengths that both dictionaries give to a window are in a toxic document."""

    def __init__(self, ordinary: bytes, toxic: bytes, times: np.ndarray):
        self.ordinary, self.toxic, self.times = Lengths(ordinary), Lengths(toxic), times.tolist()
        self.known: dict[bytes, float] = {}

    def surplus(self, window: bytes) -> float:
        found = self.known.get(window)
        if found is None:
            ordinary, toxic = (min(max(x.fixed + len(window) - x.length(window), 0), MOST - 1) for x in (self.ordinary, self.toxic))
            found = self.times[(min(len(window), MOST - 1) * MOST + ordinary) * MOST + toxic]
            if len(window) <= LONGEST:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[window] = found
        return found

    def features(self, text: str) -> list[float]:
        found = windows(text)
        times = np.fromiter(map(self.surplus, found), float, len(found))
        return [1.0, *(math.log1p((times >= least).sum()) for least in GAINS), math.log1p(len(found)) / 4]


def trained(size: int, samples: list[bytes]) -> bytes:
    """A dictionary that zstandard trains on samples, in an order that only depends on them."""
    import zstandard as z

    times = Counter(samples)
    dealt = sorted(times, key=lambda x: (zlib.crc32(x), x))
    padded = (b" " + x + b" " for x in dealt)
    try:
        return z.train_dictionary(size, [p for p, x in zip(padded, dealt, strict=True) for _ in range(times[x])], k=16, d=6, steps=4).as_bytes()
    except z.ZstdError:
        return recurring(size, samples)  # too few or too short ones


def recurring(size: int, samples: list[bytes]) -> bytes:
    """A dictionary of the samples that come most often, these last, where they are nearest to what is compressed."""
    times = Counter(samples)
    content = b"".join(b" " + x for x in sorted(times, key=lambda x: (times[x], x)))
    return content[-size:] + b" " if content else b""


def of_documents(texts: list[str]) -> list[bytes]:
    """The distinct windows of each text; equal windows are one object."""
    known: dict[bytes, bytes] = {}
    return [known.setdefault(w, w) for t in texts for w in sorted(set(windows(t)))]


class Lengths:
    """Lengths that one dictionary gives to windows."""

    def __init__(self, content: bytes):
        self.length = coder(content)
        strange = bytes(range(1, 9))
        self.fixed = self.length(strange) - len(strange)  # of a window that the dictionary doesn't know

    def saved(self, found: list[bytes]) -> np.ndarray:
        """Bytes of each window that the dictionary explains; each distinct window is measured once."""
        known = {w: self.fixed + len(w) - self.length(w) for w in set(found)}
        return np.clip(np.fromiter(map(known.__getitem__, found), int, len(found)), 0, MOST - 1)


def cells(found: list[bytes], ordinary: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    size = np.minimum(np.fromiter(map(len, found), int, len(found)), MOST - 1)
    return (size * MOST + ordinary) * MOST + toxic


def surplus(own: list[bytes], own_saved: np.ndarray, back: list[bytes], back_saved: np.ndarray, toxic: bytes) -> np.ndarray:
    """How many times as often toxic documents fill each cell of lengths; 0 where the toxic dictionary saves no more."""
    lengths = Lengths(toxic)
    rate = np.bincount(cells(own, own_saved, lengths.saved(own)), minlength=MOST**3) / max(1, len(own))
    usual = (np.bincount(cells(back, back_saved, lengths.saved(back)), minlength=MOST**3) + 3) / max(1, len(back))
    cell = np.arange(MOST**3)
    return np.where(cell % MOST > cell // MOST % MOST + 1, rate / usual, 0.0)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 0.05) -> np.ndarray:
    """Logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(rows: list[tuple[int, str, int]]) -> Model:
    """A model of rows (doc_id, text, label), at most SAMPLE of them."""
    rows = [(i, t, int(bool(y))) for i, t, y in rows]
    apart = [r for r in rows if id_crc(r[0]) // FOLDS % 4 == 0]
    if min(sum(y for *_, y in apart), sum(1 - y for *_, y in apart)) >= APART:
        taught = [r for r in rows if id_crc(r[0]) // FOLDS % 4]
    else:
        taught = apart = rows
    part = lambda label, k, n: of_documents([t for i, t, y in taught if y == label and id_crc(i) // 20 % n in k])
    ordinary = trained(ORDINARY_BYTES, part(0, (0, 1), 3))
    by_ordinary = Lengths(ordinary)
    back, halves = part(0, (2,), 3), [part(1, (0,), 2), part(1, (1,), 2)]
    back_saved, usual, chosen = by_ordinary.saved(back), Counter(back), []
    for own in halves:
        seen, share = Counter(own), len(own) / max(1, len(back))
        chosen.append([w for w in own if seen[w] >= max(RECURRING, CONTRAST * share * (usual[w] + 1))])
    if not any(chosen):
        return Model(b"", b"", np.zeros(0), (), False)
    toxic = recurring(TOXIC_BYTES, chosen[0] + chosen[1])
    crossed = [surplus(h, by_ordinary.saved(h), back, back_saved, recurring(TOXIC_BYTES, other)) for h, other in zip(halves, chosen[::-1], strict=True)]
    times = (crossed[0] + crossed[1]) / 2
    distance = Distance(ordinary, toxic, times)
    x = np.array([distance.features(t) for _, t, _ in apart])
    return Model(ordinary, toxic, times, tuple(fit(x, np.array([y for *_, y in apart], float))))


def that_fit(sizes: list[int], most: int) -> list[int]:
    """Places of those that are taken, in order, as long as they fit: one that doesn't is passed over, not the rest with it."""
    taken, total = [], 0
    for k, size in enumerate(sizes):
        if total + size <= most:
            taken.append(k)
            total += size
    return taken


def labelled(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", sample_bytes: int | None = None,
) -> DataFrame:
    """Rows (doc_id, text, toxic) that may be learnt from: at most `sample`, with at most `sample_bytes` (SAMPLE_BYTES) of text in all.

    They come in the order of a seeded hash (ties by doc_id, then a hash of the text). A text that doesn't fit any more is passed
    over. Rows that repeat a document and its text count once; of several labels of a document the highest does. Only numbers
    are gathered to choose them.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (id_crc_col() % FOLDS != HELD))
    order = seeded_hash(41, id_text())
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(order, "doc_id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    sized = texts.select("doc_id", F.xxhash64("text").alias("own"), F.octet_length("text").alias("bytes")).distinct()
    rows = sized.orderBy(order, "doc_id", "own").limit(sample).collect()
    taken = [(k, rows[k].doc_id, rows[k].own) for k in that_fit([r.bytes for r in rows], SAMPLE_BYTES if sample_bytes is None else sample_bytes)]
    picked = docs.sparkSession.createDataFrame(taken, "place int, doc_id long, own long")
    found = texts.withColumn("own", F.xxhash64("text")).join(F.broadcast(picked), ["doc_id", "own"]).dropDuplicates(["place"])
    return found.orderBy("place").select("doc_id", "text", "toxic")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int | None = None) -> Model:
    return learn([(r.doc_id, r.text, r.toxic) for r in labelled(docs, labels, sample, sample_bytes=sample_bytes).collect()])


def score(model: Model, text: str) -> float:
    """0 to 1; without a trained model every text is ordinary."""
    if not model.trained:
        return 0.0
    x = kept_for(("toxicity", model.ordinary, model.toxic), lambda: Distance(model.ordinary, model.toxic, model.times)).features(text)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(model.weights, x, strict=True))))))


def toxicity(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", sample_bytes: int | None = None,
) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null texts count as empty. Rows that repeat are scored alike, texts of any length are read whole, and other columns
    of `docs` are not read. Labels of documents that aren't in the table teach nothing; without toxic labels, or
    without windows that only toxic documents have, every score is 0. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(train(docs, labels, sample, sample_bytes))

    @frugal
    def run(batches):
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            scores = [score(shared.value, t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), pa.array([id_crc(i) % FOLDS == HELD for i in ids], pa.bool_()),
                pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()),
            ], names=["doc_id", "held_out", "score", "predicted"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return texts.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text_col: str = "text", sample_bytes: int | None = None) -> DataFrame:
    """The documents that aren't predicted toxic, with all their columns and values, whatever they are called."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(train(docs, labels, sample, sample_bytes))

    @frugal
    def run(batches):
        for b in batches:
            yield b.filter(pa.array([score(shared.value, t.as_py() or "") < 0.5 for t in b.column(text_col)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
