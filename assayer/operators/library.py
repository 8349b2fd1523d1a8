"""Artefact library: lookups by several keys, two-sided status, sync plans, folders and staleness of uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions import thresholds as T


def lookup(rows: DataFrame, index: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Adds `found` from index (key, value, ord): by the first of `keys` that leads to a value that isn't empty.

    The last of several entries of a key holds. The index is deduplicated by a grouped maximum, not by a window.
    """
    last = index.groupBy("key").agg(F.max_by("value", "ord").alias("value")).where("value <> ''")
    for n, key in enumerate(keys):
        rows = rows.join(last.select(F.col("key").alias(f"_k{n}"), F.col("value").alias(f"_v{n}")), F.col(key) == F.col(f"_k{n}"), "left")
    drop = [f"_{c}{n}" for n in range(len(keys)) for c in "kv"]
    return rows.withColumn("found", F.coalesce(*(f"_v{n}" for n in range(len(keys))))).drop(*drop)


def status(cards: DataFrame, local: DataFrame, remote: DataFrame, key: str = "key") -> DataFrame:
    """Cards with the bytes of both copies and in_sync, stale, missing (remotely) or remote_only; those with neither go."""
    both = cards.join(local.select(key, F.col("bytes").alias("local_bytes")), key, "left").join(
        remote.select(key, F.col("bytes").alias("remote_bytes")), key, "left")
    here, there = F.col("local_bytes"), F.col("remote_bytes")
    same = (here > 0) & (here == there)
    state = F.when(here.isNull(), "remote_only").when(there.isNull(), "missing").when(same, "in_sync").otherwise("stale")
    return both.where(here.isNotNull() | there.isNotNull()).withColumn("status", state)


def sync_plan(cards: DataFrame) -> DataFrame:
    """Adds the action of rows (current, dest: paths; local_bytes, current_bytes, dest_bytes: null if absent).

    A copy elsewhere is moved to its destination, a missing one copied from the local one, a kept one replaced if
    sizes differ; without any source the card is skipped.
    """
    moves = F.col("current_bytes").isNotNull() & (F.col("current") != F.col("dest"))
    after = F.when(moves, F.col("current_bytes")).otherwise(F.coalesce("dest_bytes", "local_bytes", "current_bytes"))
    differs = F.coalesce(F.col("local_bytes") != after, F.lit(False))
    nothing = F.coalesce("local_bytes", "current_bytes", "dest_bytes").isNull()
    action = (
        F.when(nothing, "skipped").when(moves, "moved").when(F.col("dest_bytes").isNull(), "copied")
        .when(differs, "replaced").otherwise("kept")
    )
    return cards.withColumn("action", action)


def tally(plan: DataFrame, domain: tuple[str, ...] = T.ACTIONS, column: str = "action") -> DataFrame:
    """Counts of a closed domain, zeros included."""
    sums = plan.agg(*(F.count_if(F.col(column) == a).alias(a) for a in domain))
    each = F.explode(F.array(*[F.struct(F.lit(a).alias(column), F.col(a).alias("n")) for a in domain])).alias("x")
    return sums.select(each).select("x.*")


def outcomes(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts of a run over cards (error or null, restored): all, failed, and restored without an error."""
    bad = F.col("error").isNotNull()
    return rows.groupBy(*by).agg(F.count("*").alias("cards"), F.count_if(bad).alias("failed"), F.count_if(~bad & F.coalesce("restored", F.lit(False))).alias("restored"))


def upload_state(mods: DataFrame, uploads: DataFrame, key: str = "id") -> DataFrame:
    """none, uploaded, or stale where size or time differ; a file that is gone stays uploaded."""
    known = uploads.select(key, F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.lit(True).alias("_up"))
    differs = (F.col("bytes") != F.col("_size")) | (F.col("mtime") != F.col("_mtime"))
    state = F.when(F.col("_up").isNull(), "none").when(F.coalesce(differs, F.lit(False)), "stale").otherwise("uploaded")
    return mods.join(known, key, "left").withColumn("upload_state", state).drop("_size", "_mtime", "_up")


def unique_match(wanted: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """Adds `match`, the id of the only entry with the same name but for case; null if there are several."""
    lone = names.groupBy(F.lower(name).alias("_key")).agg(F.min("id").alias("match"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    return wanted.join(lone, F.lower(name) == F.col("_key"), "left").drop("_key")


def backup_choice(cards: DataFrame, copies: DataFrame, key: str = "key") -> DataFrame:
    """The copy with the card's very name, else the first by lower-cased name."""
    joined = cards.join(copies, key, "left")
    w = Window.partitionBy(key).orderBy(F.desc(F.coalesce(F.col("file") == F.col("name"), F.lit(False))), F.lower("file"), "file")
    return joined.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def remote_copy(cards: DataFrame, files: DataFrame, key: str = "key") -> DataFrame:
    """Adds `copy`: of the paths that exist (files: path, name, id) the last output, else the destination, else the only file of
    that name, whatever its case."""
    there = files.select("path").distinct()
    for column in ("last", "dest"):
        cards = cards.join(there.withColumnRenamed("path", f"_{column}"), F.col(column) == F.col(f"_{column}"), "left")
    lone = files.groupBy(F.lower("name").alias("_key")).agg(F.min("path").alias("_lone"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    return cards.join(lone, F.lower("name") == F.col("_key"), "left").withColumn("copy", F.coalesce("_last", "_dest", "_lone")).drop("_last", "_dest", "_lone", "_key")


def upload_source(wanted: DataFrame, library: DataFrame, studio: DataFrame, key: str = "id") -> DataFrame:
    """Adds `source`: the library's file (id, path), else the studio's remote copy, else its local one (id, remote, local)."""
    own = library.select(key, F.col("path").alias("_p"))
    other = studio.select(key, F.coalesce("remote", "local").alias("_s"))
    return wanted.join(own, key, "left").join(other, key, "left").withColumn("source", F.coalesce("_p", "_s")).drop("_p", "_s")


def install_plan(wanted: DataFrame, local: DataFrame, there: DataFrame, key: str = "key") -> DataFrame:
    """key and action of installing local copies: copy, replace where that is asked for, refuse where a copy is there, missing
    without a local one."""
    here = local.select(key).distinct().withColumn("_h", F.lit(True))
    known = there.select(key).distinct().withColumn("_t", F.lit(True))
    action = F.when(F.col("_h").isNull(), "missing").when(F.col("_t").isNull(), "copy").when(F.coalesce("replace", F.lit(False)), "replace").otherwise("refuse")
    return wanted.join(here, key, "left").join(known, key, "left").select(key, action.alias("action"))


def renamed(folders: DataFrame, old: str, new: str, folder: str = "folder") -> DataFrame:
    """Folders with `old` and all below it moved to `new`; an error if that is in itself, not there, or taken."""
    if not old or not new or new.startswith(old + "/"):
        raise ValueError("a folder can't be moved there")
    facts = folders.agg(F.bool_or(F.col(folder) == old).alias("_old"), F.bool_or(F.col(folder) == new).alias("_new"))
    wrong = F.when(~F.coalesce("_old", F.lit(False)), F.raise_error(F.lit(f"no folder {old}")).cast("boolean")).when(
        F.col("_new") & F.lit(old != new), F.raise_error(F.lit(f"{new} exists")).cast("boolean")).otherwise(True)
    checked = folders.join(F.broadcast(facts.select(wrong.alias("_ok"))), F.col("_ok"))  # one row
    return checked.drop("_ok").withColumn(folder, X.moved(F.col(folder), old, new))


def removable(folders: DataFrame, occupied: DataFrame) -> DataFrame:
    """(folder, action): folders asked to go are removed unless an artefact is in them or below; the root is kept."""
    held = ancestors(occupied, "folder").select("folder").withColumn("_held", F.lit(True))
    action = F.when(F.coalesce("folder", F.lit("")) == "", "root").when(F.col("_held"), "occupied").otherwise("remove")
    return folders.join(held, "folder", "left").select("folder", action.alias("action"))


def ancestors(folders: DataFrame, path: str = "path") -> DataFrame:
    """Every folder and all folders above it, once, with the depth."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return folders.where(F.size(parts) > 0).select(F.explode(above).alias("folder")).distinct().withColumn("depth", F.size(F.split("folder", "/")).cast("long"))


def prunable(existing: DataFrame, wanted: DataFrame, occupied: DataFrame) -> DataFrame:
    """Existing folders that are neither wanted nor above or equal to an occupied one, with their depth, to be removed deepest first."""
    return existing.join(wanted.select("folder"), "folder", "left_anti").join(ancestors(occupied, "folder").select("folder"), "folder", "left_anti").select(
        "folder", F.size(F.split("folder", "/")).cast("long").alias("depth"))


def grouped_with_empty(rows: DataFrame, folders: DataFrame, folder: str = "folder") -> DataFrame:
    """Number of rows in every known folder, the root ('') first; folders without rows count 0."""
    counts = rows.groupBy(folder).agg(F.count("*").alias("n"))
    return folders.select(folder).distinct().join(counts, folder, "left").withColumn("n", F.coalesce("n", F.lit(0))).orderBy(F.col(folder) != "", folder)
