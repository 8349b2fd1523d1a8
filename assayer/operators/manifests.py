"""Manifests of datasets: defaults, coercion, patches, item rows, and what creating, moving and deleting does to the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions import paths as P
from ..functions import thresholds as T

#: What an extraction has unless a manifest says otherwise, and names of modes that mean another one.
EXTRACT = {"resolution": 512, "max_tokens": 8192, "pool": 4, "identity": 0, "multiplier": 1}
MODES, DEVICES = {"full": "encode", "pooled": "training", "optimize": "training", "svd": "training", "encode": "encode", "training": "training"}, ("auto", "cuda", "cpu")
CLEAN = ("flagged", "cleaned", "ignored")
LEVELS = ("need", "improve", "ok")


def empty(slugs: DataFrame, display: str = "display_name") -> DataFrame:
    """The manifest of a new dataset, from (slug, display name or null)."""
    name, shown = X.slug(F.col("slug")), F.coalesce(F.nullif(F.trim(F.coalesce(display, "slug")), F.lit("")), X.slug(F.col("slug")))
    return slugs.select(
        "slug", name.alias("name"), shown.alias("display_name"), F.lit(T.CONCEPTS[0]).alias("concept_type"), shown.alias("description"),
        X.artefact_name(name, F.lit("set")).alias("mod_name"), F.lit(False).alias("linked"), F.lit(T.CONCEPTS[0]).alias("subfolder"),
        F.lit("").alias("cover"), F.lit("").alias("notes"))


def extract_settings(saved: Column) -> Column:
    """Settings of an extraction: whole numbers by name, the mode and the device, defaults where nothing usable is given.

    `saved` is a map of texts. A number that isn't one fails, as it would when the manifest is saved.
    """
    def number(k: str) -> Column:
        text = F.nullif(F.try_element_at(saved, F.lit(k)), F.lit(""))
        bad = F.raise_error(F.concat(F.lit(f"{k} must be a number: "), text)).cast("int")
        return F.when(text.isNull(), F.lit(EXTRACT[k])).otherwise(F.coalesce(text.try_cast("double").cast("int"), bad)).alias(k)

    mode, device = (F.lower(F.try_element_at(saved, F.lit(k))) for k in ("mode", "device"))
    known = F.create_map(*(F.lit(x) for pair in MODES.items() for x in pair))
    return F.struct(*(number(k) for k in EXTRACT), F.coalesce(F.try_element_at(known, mode), F.lit("encode")).alias("mode"),
                    F.when(device.isin(*DEVICES), device).otherwise("auto").alias("device"))


def parsed(raw: DataFrame, text: str = "text") -> DataFrame:
    """Adds name, concept_type, notes and items of manifests as JSON texts; what isn't an object counts as an empty one.

    An item is a file name or an object; those without a name go, of equal names the first stays, unknown values of
    closed domains become empty, and `enabled` is true unless it is given.
    """
    read = raw.withColumn("_m", F.from_json(text, "name string, display_name string, concept_type string, notes string, items array<string>"))
    one = "file string, shot string, enabled boolean, clean string"

    def item(x: Column) -> Column:
        o = F.from_json(F.when(x.startswith("{"), x), one)
        file = P.base(F.when(x.startswith("{"), F.coalesce(o["file"], F.lit(""))).otherwise(x))
        clean = F.lower(F.trim(F.coalesce(o["clean"], F.lit(""))))
        return F.struct(file.alias("file"), X.one_of(o["shot"], T.SHOTS, "").alias("shot"),
                        F.coalesce(o["enabled"], F.lit(True)).alias("enabled"), X.one_of(clean, CLEAN, "").alias("clean"))

    named = F.filter(F.transform(F.coalesce(F.col("_m.items"), F.array().cast("array<string>")), item), lambda i: i["file"] != "")
    files = F.transform(F.col("_named"), lambda i: i["file"])
    first = F.filter(F.col("_named"), lambda i, k: F.array_position(F.col("_files"), i["file"]) == k + 1)
    return read.withColumn("_named", named).withColumn("_files", files).withColumns({
        "name": F.coalesce(X.slug(F.col("_m.name")), F.lit("dataset")), "concept_type": X.one_of(F.col("_m.concept_type"), T.CONCEPTS, T.CONCEPTS[0]),
        "notes": F.coalesce("_m.notes", F.lit("")), "items": first}).drop("_m", "_named", "_files")


def advice(raw: Column) -> Column:
    """Advice as a list of (id, level, text): without text it goes, an unknown level means improve."""
    text = lambda a: F.trim(F.coalesce(a["text"], F.lit("")))
    kept = F.filter(F.coalesce(raw, F.array().cast("array<struct<id:string,level:string,text:string>>")), lambda a: text(a) != "")
    return F.transform(kept, lambda a: F.struct(
        F.coalesce(a["id"], F.lit("")).alias("id"), X.one_of(F.trim(a["level"]), LEVELS, "improve").alias("level"), text(a).alias("text")))


def payload(items: DataFrame, files: DataFrame, captions: DataFrame, originals: DataFrame) -> DataFrame:
    """Item rows (slug, file, shot, enabled) with what the folder holds: kind, bytes, sides, low_res, caption, missing, has_original.

    `files` is (slug, file, bytes, w, h), `captions` (slug, stem, caption), `originals` (slug, file). Four tables meet
    on (slug, file) or (slug, stem); none is broadcast, as all grow with the items.
    """
    kept = originals.select("slug", "file").distinct().withColumn("_o", F.lit(True))
    named = items.withColumn("stem", P.stem(F.col("file")))
    joined = named.join(files, ["slug", "file"], "left").join(captions, ["slug", "stem"], "left").join(kept, ["slug", "file"], "left")
    kind = F.coalesce(X.media_kind(F.col("file")), F.lit("other"))
    short = F.when(kind == "image", F.least("w", "h"))
    return joined.select(
        "slug", "file", F.coalesce("shot", F.lit("")).alias("shot"), F.coalesce("enabled", F.lit(True)).alias("enabled"), kind.alias("kind"),
        F.coalesce("bytes", F.lit(0)).alias("bytes"), short.alias("short_edge"), F.coalesce(short < T.LOW_RESOLUTION, F.lit(False)).alias("low_res"),
        F.trim(F.coalesce("caption", F.lit(""))).alias("caption"), F.col("bytes").isNull().alias("missing"), F.coalesce("_o", F.lit(False)).alias("has_original"))


def patched(datasets: DataFrame, updates: DataFrame) -> DataFrame:
    """Datasets with the fields that an update gives: a blank display name keeps the old one, an unknown concept fails,
    a mod name is made safe (and the default one if nothing is left), notes may be emptied."""
    new = updates.select("slug", *(F.col(c).alias(f"_{c}") for c in updates.columns if c != "slug"))
    joined = datasets.join(new, "slug", "left")
    concept = F.nullif(F.col("_concept_type"), F.lit(""))
    unknown = F.raise_error(F.concat(F.lit("unknown concept: "), concept)).cast("string")
    safe = F.coalesce(F.nullif(X.safe_name(F.col("_mod_name")), F.lit("")), X.artefact_name(F.col("slug"), F.lit("set")))
    fields = {
        "display_name": F.coalesce(F.nullif(F.trim("_display_name"), F.lit("")), "display_name"),
        "description": F.coalesce("_description", "description"),
        "concept_type": F.when(concept.isNull(), F.col("concept_type")).when(concept.isin(*T.CONCEPTS), concept).otherwise(unknown),
        "mod_name": F.when(F.coalesce("_mod_name", F.lit("")) == "", F.col("mod_name")).otherwise(safe),
        "notes": F.coalesce("_notes", "notes"),
    }
    given = [c for c in fields if f"_{c}" in joined.columns and c in datasets.columns]
    return joined.select(*(fields[c].alias(c) if c in given else F.col(c) for c in datasets.columns))


def without_file(gone: DataFrame, items: DataFrame, captions: DataFrame, originals: DataFrame, datasets: DataFrame) -> dict[str, DataFrame]:
    """What deleting files (slug, file) leaves of items, captions, originals and datasets (whose cover may be such a file)."""
    keys = gone.select("slug", "file").distinct()
    stems = keys.select("slug", P.stem(F.col("file")).alias("stem")).distinct()
    covers = keys.withColumnRenamed("file", "cover").withColumn("_g", F.lit(True))
    cleared = datasets.join(covers, ["slug", "cover"], "left").withColumn("cover", F.when(F.col("_g"), "").otherwise(F.col("cover"))).select(*datasets.columns)
    return {
        "items": items.join(keys, ["slug", "file"], "left_anti"), "captions": captions.join(stems, ["slug", "stem"], "left_anti"),
        "originals": originals.join(keys, ["slug", "file"], "left_anti"), "datasets": cleared}


def delete_plan(datasets: DataFrame, links: DataFrame, root: str) -> DataFrame:
    """slug and action: a linked dataset is unlinked, one in the root removed, any other refused."""
    linked = links.select("slug").distinct().withColumn("_l", F.lit(True))
    own = P.under(F.col("folder"), root) & (P.posix(F.col("folder")) != root)
    action = F.when(F.col("_l"), "unlink").when(own, "remove").otherwise("refuse")
    return datasets.join(linked, "slug", "left").select("slug", action.alias("action"))


def retargeted(datasets: DataFrame, moves: DataFrame) -> DataFrame:
    """Datasets whose last output was moved (old, new) point to the new place; one without a hash counts as extracted afresh."""
    moved = moves.select(F.col("old").alias("output"), F.col("new").alias("_new"))
    joined = datasets.join(moved, "output", "left")
    fresh = F.col("_new").isNotNull() & (F.coalesce("content_hash", F.lit("")) == "")
    return joined.select("slug", F.coalesce("_new", "output").alias("output"), F.when(fresh, F.col("current_hash")).otherwise(F.col("content_hash")).alias("content_hash"))


def identity_of_sheet(file: Column, place: Column, count: Column, name: Column, display: Column) -> Column:
    """Name and display name of a sheet's dataset: one sheet alone, or the first, may have given ones; others go by their file."""
    own = F.coalesce(F.nullif(P.stem(file), F.lit("")), F.lit("dataset"))
    given, shown = (F.nullif(F.trim(x), F.lit("")) for x in (name, display))
    mine = (count == 1) | ((place == 0) & given.isNotNull())
    return F.struct(F.when(mine, F.coalesce(given, own)).otherwise(own).alias("name"),
                    F.when(mine, F.coalesce(shown, given, own)).otherwise(own).alias("display_name"))


def sheet_plan(sheets: DataFrame, plans: DataFrame, found: DataFrame, existing: DataFrame, batch: str = "batch", least: int = 2) -> DataFrame:
    """Whether datasets can be made of sheets (batch, place, file, name, display_name), all of a batch or none.

    `plans` (batch, file, boxes) are chosen cuts, `found` (batch, file, panels) what a splitter finds, `existing` (slug)
    the datasets there are. Gives slug, display_name, panels, error (of the sheet) and created (no sheet of the batch has one).
    """
    w = Window.partitionBy(batch)
    named = sheets.withColumn("_id", identity_of_sheet(F.col("file"), F.col("place"), F.count("*").over(w), F.col("name"), F.col("display_name")))
    rows = named.select(batch, "place", "file", X.slug(F.col("_id.name")).alias("slug"), F.col("_id.display_name").alias("display_name"))
    joined = rows.join(plans.select(batch, "file", "boxes"), [batch, "file"], "left").join(found.select(batch, "file", "panels"), [batch, "file"], "left")
    joined = joined.join(existing.select("slug").distinct().withColumn("_e", F.lit(True)), "slug", "left")
    panels = F.coalesce("boxes", "panels", F.lit(0))
    again = F.row_number().over(Window.partitionBy(batch, "slug").orderBy("place")) > 1
    error = (
        F.when(F.coalesce(X.media_kind(F.col("file")), F.lit("")) != "image", "not an image").when(F.col("_e") | again, "exists")
        .when(panels < F.when(F.col("boxes").isNull(), least).otherwise(1), "too few panels")
    )
    checked = joined.withColumn("panels", panels).withColumn("error", error)
    return checked.select(batch, "place", "slug", "display_name", "panels", "error", (F.count("error").over(w) == 0).alias("created"))


def saved_config(old: Column, new: Column, secrets: tuple[str, ...], flags: tuple[str, ...], mask: str = "••••") -> Column:
    """A map of settings overlaid by new ones: keys that aren't known and masked secrets change nothing, flags become true or false."""
    known = F.map_filter(new, lambda k, v: F.array_contains(F.map_keys(old), k) & v.isNotNull() & ~(k.isin(*secrets) & ((v == mask) | (v == ""))))
    clean = F.transform_values(known, lambda k, v: F.when(k.isin(*flags), P.flag(v).cast("string")).otherwise(F.trim(v)))
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(clean), k)), clean)


def overview(items: DataFrame) -> DataFrame:
    """Counts of kinds, presence and shots of every dataset in one aggregate, from payload() rows."""
    here, still = ~F.col("missing"), F.col("kind") == "image"
    counted = F.col("enabled") & (F.col("kind") != "video")
    tagged = F.col("shot").isin(*T.SHOTS)
    return items.groupBy("slug").agg(
        F.count_if(here & still).alias("images"), F.count_if(here & (F.col("kind") == "video")).alias("videos"),
        F.count_if(here & F.col("enabled")).alias("enabled"), F.count_if(here).alias("total"), F.count_if(F.col("low_res")).alias("low_res"),
        *(F.count_if(counted & (F.col("shot") == s)).alias(s.replace("-", "_")) for s in T.SHOTS), F.count_if(counted & ~tagged).alias("untagged"))
