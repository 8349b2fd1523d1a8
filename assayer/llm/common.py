"""Helpers that the training-data operators share."""

from __future__ import annotations

import functools
import tempfile
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Most rows that are ever broadcast by the operators here; each use proves its bound.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> None:
    """Make reliable checkpoints possible: the folder that the cluster names, or one of our own where all runs in one process.

    On a cluster that names none this fails, as a folder of one machine would not outlive it.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context._jsc.sc().isLocal():
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        folder = tempfile.mkdtemp(prefix="assayer-checkpoints-")
    context.setCheckpointDir(folder)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: its rows survive the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def give_back() -> None:
    """Returns freed memory of a Python worker to the system, where the C library can."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def frugal(f):
    """For what a worker runs on batches: as workers are used again, a task leaves no freed memory behind."""

    @functools.wraps(f)
    def run(batches):
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def frugal_group(f):
    """The same for what is run on a group."""

    @functools.wraps(f)
    def run(table):
        try:
            return f(table)
        finally:
            give_back()

    return run


#: Bytes of the batches in which Spark sends texts to Python workers, and the setting that bounds them.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes: a batch takes its size several times over in both processes of each running task. One
    value for all operators, set only where the session has none of its own; results never depend on it."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def in_parts(batches, rows: int = 512):
    """Arrow batches cut to at most so many rows, so that what is made of their texts at once stays small."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


_kept: list = [None, None]


def kept_for(key, make):
    """What a Python worker keeps from batch to batch: one thing, so that a worker that goes on to another operator, or to
    another model, gives up what it kept before."""
    if _kept[0] != key:
        _kept[:] = None, None
        give_back()
        _kept[:] = key, make()
    return _kept[1]


def unused(df: DataFrame, stem: str) -> str:
    """A name for a column of our own that none of the frame's columns has, whatever their case."""
    taken = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def id_text(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("null"))


def own_text(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The identifier as text; rows without one go by a digest of their text instead, so that they don't share a draw."""
    return F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.md5(text_of(text_col).cast("binary"))))


def seeded_hash(seed: int, *parts: Column) -> Column:
    """60 uniform bits of the parts and the seed, the same in any engine that has MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *parts)
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def id_crc(doc_id) -> int:
    """crc32 of the identifier as text (null: the empty text), on which folds are fixed."""
    return zlib.crc32(b"" if doc_id is None else str(int(doc_id)).encode())


def id_crc_col(column: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def heavy_split(facts: DataFrame, dimension: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join of facts to a dimension with one row per key, where one key may hold a third of the facts.

    `weight` is the number of facts of each key of the dimension and `total` their sum. Keys of at least
    max(64, total / BROADCAST_ROWS) facts number at most BROADCAST_ROWS, so they are broadcast; the others
    are joined by a shuffle in which no key is large.
    """
    limit = max(64, total // BROADCAST_ROWS + 1)
    heavy = dimension.where(F.col(weight) >= limit)
    light = dimension.where(F.col(weight) < limit)
    mark = heavy.select(F.col(key).alias("_heavy"))
    rest = facts.join(F.broadcast(mark), F.col(key) == F.col("_heavy"), "left_anti")
    return facts.join(F.broadcast(heavy), key).unionByName(rest.join(light, key))


#: For texts of bytes whose terms are runs of ASCII letters and digits and of all beyond ASCII: what separates terms becomes
#: a blank, A-Z small letters. A stretch is cut at a blank, so that a very long text isn't listed whole.
TERM_BYTES = bytes(32 if b < 128 and not chr(b).isalnum() else b + 32 if 65 <= b <= 90 else b for b in range(256))
STRETCH = 1 << 20


def term_lists(data: bytes | None):
    """The terms of a text in order, in lists of about a stretch each."""
    clean, start = (data or b"").translate(TERM_BYTES), 0
    while start < len(clean):
        end = clean.find(b" ", start + STRETCH)
        end = len(clean) if end < 0 else end
        yield clean[start:end].split()
        start = end
