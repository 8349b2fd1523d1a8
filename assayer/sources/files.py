"""Sources: folders of media, manifests, captions, link tables, artefact headers and indented settings."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions import paths as P
from ..functions import thresholds as T
from ..operators import listing

MANIFEST = (
    "name string, display_name string, concept_type string, description string, mod_name string, subfolder string, cover string, "
    "notes string, items array<struct<file string, shot string, enabled boolean, clean string>>"
)
PRUNED = ("graph_presets", ".git", "__pycache__")
#: Bytes at the head of an artefact that give the length of its JSON header, and the longest that is read.
HEAD, LONGEST = 8, 100 << 20


def media_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """path, folder, file, suffix, kind, size, time and place (by lower-cased name, in the folder) of images and videos; contents
    are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select(
        "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    named = files.withColumns({"file": F.element_at(F.split("path", "/"), -1), "folder": F.regexp_replace("path", "/[^/]*$", "")})
    return listing.media(named.withColumn("suffix", X.suffix(F.col("file"))), ["folder"])


def manifests(spark: SparkSession, paths: str) -> DataFrame:
    """path and the manifest's fields, coerced; a file that isn't a JSON object gives a row of defaults."""
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    read = raw.withColumn("m", F.from_json("value", MANIFEST)).select("path", "m.*")
    return read.withColumn("concept_type", X.one_of(F.col("concept_type"), T.CONCEPTS, T.CONCEPTS[0])).withColumn("items", F.coalesce("items", F.array().cast(read.schema["items"].dataType)))


def captions(spark: SparkSession, paths: str) -> DataFrame:
    """path, stem and the trimmed text of caption files."""
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("caption"))
    return raw.withColumn("stem", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", ""))


def links(spark: SparkSession, path: str) -> DataFrame:
    """slug and folder of a JSON map; empty names and folders are dropped."""
    return link_rows(spark.read.text(path, wholetext=True))


def link_rows(raw: DataFrame) -> DataFrame:
    rows = raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("slug", "folder"))
    return rows.where("trim(slug) <> '' AND trim(folder) <> ''")


def datasets(children: DataFrame, linked: DataFrame) -> DataFrame:
    """Child folders (slug, folder) whose names don't start with _, overlaid by links of the same slug."""
    own = children.where(~F.col("slug").startswith("_")).withColumn("ord", F.lit(0))
    both = own.unionByName(linked.withColumn("ord", F.lit(1)))
    return both.groupBy("slug").agg(F.max_by("folder", "ord").alias("folder"), F.max("ord").cast("boolean").alias("linked"))


def artefacts(spark: SparkSession, folder: str) -> DataFrame:
    """path, below (the path below the folder), bytes, likely_empty, metadata (map) and error of artefact files.

    Of a file only its header is read, where the task runs; `walked` says which files count.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.safetensors").load(folder)
    kept = walked(files.select("path", F.col("length").alias("bytes")), folder)

    def head(path: str) -> tuple[dict[str, str], str | None]:
        from pyarrow import fs

        try:
            system, inner = fs.FileSystem.from_uri(path)
            with system.open_input_file(inner) as f:
                size = int.from_bytes(f.read(HEAD), "little")
                if size > min(LONGEST, f.size() - HEAD):
                    return {}, "header too long"
                meta = json.loads(f.read(size)).get("__metadata__") or {}
            return {str(k): v if isinstance(v, str) else json.dumps(v) for k, v in meta.items()}, None
        except (OSError, ValueError, AttributeError) as e:
            return {}, str(e)

    def run(batches):
        for pdf in batches:
            found = [head(p) for p in pdf["path"]]
            yield pdf.assign(metadata=[m for m, _ in found], error=[e for _, e in found])

    rows = kept.mapInPandas(run, "path string, bytes long, below string, metadata map<string,string>, error string")
    return rows.withColumns({"name": F.element_at(F.split("path", "/"), -1), "likely_empty": F.col("bytes") < T.LIKELY_EMPTY_BYTES})


def walked(files: DataFrame, root: str, path: str = "path") -> DataFrame:
    """Adds `below`, the path below the root, and keeps files that no pruned or hidden folder holds."""
    bare = F.regexp_replace(path, "^[a-z0-9]+:/*(?=/)", "")
    start = len(re.sub("^[a-z0-9]+:/*(?=/)", "", root.rstrip("/"))) + 2
    rows = files.withColumn("below", F.substr(bare, F.lit(start)))
    folders = F.slice(F.split("below", "/"), 1, F.size(F.split("below", "/")) - 1)
    return rows.where(~F.exists(folders, lambda p: F.lower(p).isin(*PRUNED) | p.startswith(".")))


def registry(raw: DataFrame, text: str = "text") -> DataFrame:
    """id, repo_id, path_in_repo, uploaded_at, size and mtime of uploads, from a JSON object {"uploads": {id: {...}}}; none of
    anything else."""
    one = "struct<repo_id:string,path_in_repo:string,uploaded_at:string,size:bigint,mtime:bigint>"
    read = raw.select(F.explode(F.from_json(text, f"uploads map<string,{one}>")["uploads"]).alias("id", "u"))
    return read.select("id", "u.*")


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """Sample prompts as a table (ord, group, title, tests, text) from a JSON-lines file; their texts are data, not code."""
    return spark.read.schema("ord long, group string, title string, tests string, text string").json(path)


def uploads(spark: SparkSession, files: list[tuple[str, bytes]]) -> DataFrame:
    """Uploaded files as rows (ord, file, content); names lose their folders, and other than media goes."""
    rows = spark.createDataFrame([(k, n, bytearray(b)) for k, (n, b) in enumerate(files)], "ord long, file string, content binary")
    return rows.withColumn("file", P.file_name(F.col("file"))).where(P.media_name(F.col("file")))


def sections(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """(doc, section, key, value) of indented `key: value` settings, in rows (doc, line_no, line).

    A line without indent opens a section; a value of | or > is followed by deeper lines, one value each. Documents are
    small files and fit a task.
    """

    def bare(text: str) -> str:
        text = text.strip()
        return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"" else text

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, section, key, depth = [], "", None, 0
        for line in pdf.sort_values("line_no")["line"]:
            text, indent = line.strip(), len(line) - len(line.lstrip())
            if not text or text.startswith("#"):
                continue
            if key is not None and indent > depth:
                out.append((section, key, bare(text)))
                continue
            name, _, value = text.partition(":")
            key = None
            if not indent:
                section = bare(name)
            elif value.strip() in ("|", ">"):
                key, depth = bare(name), indent
            else:
                out.append((section, bare(name), bare(value)))
        return pd.DataFrame([(pdf["doc"].iloc[0], *r) for r in out], columns=["doc", "section", "key", "value"])

    return lines.groupBy("doc").applyInPandas(run, f"doc {dict(lines.dtypes)['doc']}, section string, key string, value string")
