"""Tables in versions: a write publishes all of its rows and files at once, or nothing.

A table is a folder. `data/<write>/` holds what one write has staged: Parquet files, and the files of rows that carry content.
`versions/<n>.json` lists the files of version n and is what readers go by, so what is staged is seen by nobody until its
version is there. Tasks stage under names of their own and report them; files of attempts that were killed or run twice are
never listed. When all tasks are done, the version file is created under a number that must not be taken yet: of two writes
made from the same version one is published, the other one fails with `Conflict` and takes its files away.

`publish`, `create` and `replace` repeat a write that came second on the newer version, with whatever they check checked anew.
The folder must be one that the driver's and the executors' Python see under the same path.
"""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Rows of a staged file, and how often a write that came second is repeated.
FILE_ROWS, TRIES = 1 << 20, 20
CONFLICT = "another write was published first"


class Conflict(RuntimeError):
    """Another write was published since the version that this one was made from."""


def local(path: str) -> str:
    """The path as Python opens it; a store without atomic creation of files is refused."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"versions need a folder that can be opened as one: {path}")
    return parts.path if parts.scheme else path


def latest(path: str) -> int:
    """The number of the last version, 0 if there is none."""
    folder = os.path.join(local(path), "versions")
    names = os.listdir(folder) if os.path.isdir(folder) else []
    return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)


def entry(path: str, version: int) -> dict:
    """What a version says of itself: files, schema and the write that made it."""
    with open(os.path.join(local(path), "versions", f"{version:012}.json")) as f:
        return json.load(f)


def create_exclusively(target: str, content: str) -> bool:
    """A file with its content under a name that isn't taken, or False; never a part of it."""
    os.makedirs(os.path.dirname(target), exist_ok=True)
    staged = f"{target}.{uuid.uuid4()}"
    with open(staged, "w") as f:
        f.write(content)
        f.flush()
        os.fsync(f.fileno())
    try:
        os.link(staged, target)
        return True
    except FileExistsError:
        return False
    finally:
        os.unlink(staged)


def discard(path: str, write: str) -> None:
    """Takes away what a write has staged. Tasks that haven't heard of it yet find no folder any more, as only the driver makes it."""
    folder = os.path.join(local(path), "data", write)
    gone = f"{folder}.gone"
    try:
        os.rename(folder, gone)
    except FileNotFoundError:
        return
    for _ in range(TRIES):
        shutil.rmtree(gone, ignore_errors=True)
        if not os.path.exists(gone):
            return
        time.sleep(0.05)


@dataclass
class Staged(WriterCommitMessage):
    """What a task has staged: Parquet files and files of content, as paths below the table."""

    files: list[str]
    blobs: int
    rows: int


class VersionWriter(DataSourceArrowWriter):
    """Stages Arrow batches; of options, `path`, `base` (the version that the rows were made from), `write` (a name of its
    own), `keep` (whether the files of the base stay), `content` (a column of bytes that become files) and `fence` (of a lease that
    must not be lost when the version is published)."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.base, self.write_id = local(options["path"]), int(options["base"]), options["write"]
        self.keep, self.content, self.schema = options.get("keep", "true") == "true", options.get("content"), schema
        self.fence = options.get("fence")

    def write(self, iterator) -> Staged:
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        task = TaskContext.get()
        attempt = f"{task.partitionId():06}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        below = os.path.join("data", self.write_id)
        files, blobs, rows, out, held = [], 0, 0, None, 0
        try:
            for batch in iterator:
                if self.content:
                    names = []
                    for k, x in enumerate(batch.column(self.content)):
                        names.append(None if not x.is_valid else os.path.join(below, "files", f"{attempt}-{rows + k}"))
                        if x.is_valid:
                            with open(os.path.join(self.path, names[-1]), "wb") as f:
                                f.write(x.as_buffer())
                            blobs += 1
                    at = batch.schema.get_field_index(self.content)
                    batch = batch.set_column(at, pa.field(self.content, pa.string()), pa.array(names, pa.string()))
                if out is None or held >= FILE_ROWS:
                    if out:
                        out.close()
                    files.append(os.path.join(below, f"{attempt}-{len(files)}.parquet"))
                    out, held = pq.ParquetWriter(os.path.join(self.path, files[-1]), batch.schema, compression="zstd"), 0
                out.write_batch(batch)
                rows, held = rows + batch.num_rows, held + batch.num_rows
        finally:
            if out:
                out.close()
        return Staged(files, blobs, rows)

    def commit(self, messages) -> None:
        old = entry(self.path, self.base) if self.base else {"files": [], "rows": 0}
        files = [f for m in messages if m for f in m.files]
        kind = self.schema.jsonValue()
        for field in kind["fields"]:
            field["type"] = "string" if field["name"] == self.content else field["type"]
        made = {
            "write": self.write_id, "base": self.base, "schema": kind, "rows": (old["rows"] if self.keep else 0) + sum(m.rows for m in messages if m),
            "files": (old["files"] if self.keep else []) + files,
        }
        if self.fence:
            from ..streaming.leases import fenced

            fenced(self.fence)
        if latest(self.path) != self.base or not create_exclusively(os.path.join(self.path, "versions", f"{self.base + 1:012}.json"), json.dumps(made)):
            raise Conflict(CONFLICT)
        folder, listed = os.path.join(self.path, "data", self.write_id), set(files)
        for name in os.listdir(folder) if os.path.isdir(folder) else []:  # of attempts that were lost after they had begun
            if name.endswith(".parquet") and os.path.join("data", self.write_id, name) not in listed:
                os.unlink(os.path.join(folder, name))

    def abort(self, messages) -> None:
        discard(self.path, self.write_id)


class Versions(DataSource):
    """The format "versions"."""

    @classmethod
    def name(cls) -> str:
        return "versions"

    def writer(self, schema: StructType, overwrite: bool) -> VersionWriter:
        return VersionWriter(dict(self.options), schema)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The rows of a version (the last one unless given), as a Parquet scan of its files; None before the first version.

    Columns and conditions are pushed down to the files. Columns of content hold the paths of the files below the table.
    """
    version = latest(path) if version is None else version
    if not version:
        return None
    said = entry(path, version)
    schema = StructType.fromJson(said["schema"])
    if not said["files"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"file://{os.path.abspath(local(path))}/{f}" for f in said["files"]))


def with_content(rows: DataFrame, path: str, content: str) -> DataFrame:
    """Rows of a table with the bytes of their files in place of the paths."""
    top = f"file:{os.path.abspath(local(path))}/"
    found = rows.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!.]*").load(f"{top}data/*/files")
    bytes_of = found.select(F.regexp_replace("path", f"^file:/+{os.path.abspath(local(path))[1:]}/", "").alias(content), F.col("content").alias("_bytes"))
    return rows.join(bytes_of, content, "left").select(*(F.col("_bytes").alias(c) if c == content else F.col(c) for c in rows.columns))


def publish(rows: DataFrame, path: str, base: int, keep: bool = True, content: str | None = None, fence: str | None = None) -> int:
    """Writes rows as the version after `base`, beside its rows or in their place; gives its number.

    A failure of any row leaves the table as it was. If another version is there by then, this raises `Conflict`. With the fence of
    a lease (`streaming.leases`), the write is refused if the lease has been lost when all rows are staged.
    """
    spark = rows.sparkSession
    spark.dataSource.register(Versions)
    options = {"path": path, "base": str(base), "write": uuid.uuid4().hex, "keep": str(keep).lower()} | ({"content": content} if content else {}) | ({"fence": fence} if fence else {})
    os.makedirs(os.path.join(local(path), "data", options["write"], *(["files"] if content else [])))
    try:
        rows.write.format("versions").options(**options).mode("append").save()
    except Exception as e:
        discard(path, options["write"])  # where the session has had no time to
        if CONFLICT in str(e):
            raise Conflict(CONFLICT) from None
        raise
    return base + 1


def changed(spark: SparkSession, path: str, make: Callable[[DataFrame | None], DataFrame], keep: bool, content: str | None = None) -> int:
    """Publishes make(rows of the last version), again on the newer version as long as another write comes first."""
    for k in range(TRIES):
        base = latest(path)
        try:
            return publish(make(read(spark, path, base)), path, base, keep, content)
        except Conflict:
            time.sleep(0.05 * (k + 1))
    raise Conflict(f"{CONFLICT}, {TRIES} times")


def create(new: DataFrame, path: str, key: str, content: str | None = None) -> int:
    """Adds rows whose keys aren't in the table; a key that is there, or that is null, fails the whole write.

    Of two writes that add one key at the same time the first succeeds: the other is checked again, against its rows.
    """

    def make(table: DataFrame | None) -> DataFrame:
        guarded = new
        if table is not None:
            known = table.select(key).distinct().withColumn("_known", F.lit(True))
            guarded = new.join(known, key, "left").select(*new.columns, "_known")
        else:
            guarded = new.withColumn("_known", F.lit(None).cast("boolean"))
        taken = F.col("_known") | F.col(key).isNull()
        wrong = F.raise_error(F.concat(F.lit("exists already, or has no key: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean")
        return guarded.where(F.when(taken, wrong).otherwise(True)).drop("_known")

    return changed(new.sparkSession, path, make, True, content)


def replace(path: str, make: Callable[[DataFrame | None], DataFrame], spark: SparkSession) -> int:
    """The rows that `make` gives for those of the last version become the table; readers of that one are not disturbed."""
    return changed(spark, path, make, False)


def vacuum(path: str, keep: int = 1, older: float = 86_400.0) -> int:
    """Deletes versions but the last `keep`, and staged writes older than `older` seconds that no version left lists files of;
    gives how many of either. Older readers must have ended."""
    top, last = local(path), latest(path)
    gone = 0
    for v in range(1, last - keep + 1):
        name = os.path.join(top, "versions", f"{v:012}.json")
        if os.path.exists(name):
            os.unlink(name)
            gone += 1
    used = {f.split("/")[1] for v in range(max(1, last - keep + 1), last + 1) for f in entry(path, v)["files"]}
    folder = os.path.join(top, "data")
    for write in os.listdir(folder) if os.path.isdir(folder) else []:
        if write not in used and time.time() - os.stat(os.path.join(folder, write)).st_mtime >= older:
            shutil.rmtree(os.path.join(folder, write))
            gone += 1
    return gone


def create_sheets(plan: DataFrame, panels: DataFrame, path: str, by: str = "batch") -> int:
    """Makes the datasets of `manifests.sheet_plan` (slug, display_name, error, created) with the files of their panels.

    `panels` (slug, file, content) are the pictures of panels. One row is written per file; a sheet with an error fails the
    write, so that of its batch, and of any other in it, no file and no row is left.
    """
    wrong = F.raise_error(F.concat_ws(": ", F.lit("sheet"), "slug", F.coalesce("error", F.lit("of a batch that fails")))).cast("boolean")
    good = plan.where(F.when(F.col("error").isNull() & F.col("created"), True).otherwise(wrong))
    rows = good.select(by, "slug", "display_name").join(panels.select("slug", "file", "content"), "slug", "left")
    return create(rows.select(by, "slug", "display_name", "file", "content"), path, "slug", "content")
