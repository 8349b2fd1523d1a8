"""Paths, identifiers and small texts of the library as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import expressions as X

#: The folder of kept originals, and an artefact's suffix.
ORIGINALS, ARTEFACT = "_originals", ".safetensors"


def posix(x: Column) -> Column:
    return F.replace(x, F.lit("\\"), F.lit("/"))


def base(x: Column) -> Column:
    return F.element_at(F.split(posix(x), "/"), -1)


def stem(x: Column) -> Column:
    """The file's name without its last suffix; a name that begins with its only dot has none."""
    return F.regexp_replace(base(x), r"(?<=.)\.[^.]*$", "")


def parent(x: Column) -> Column:
    return F.when(posix(x).contains("/"), F.regexp_replace(posix(x), "/[^/]*$", "")).otherwise("")


def relative_id(path: Column, root: str) -> Column:
    """The path below a root, without the artefact's suffix; null outside of it."""
    below = F.when(under(path, root) & (posix(path) != root), F.substr(posix(path), F.lit(len(root) + 2)))
    return F.regexp_replace(below, r"(?i)" + ARTEFACT.replace(".", r"\.") + "$", "")


def under(path: Column, root: str) -> Column:
    """Whether a path is the root or in it."""
    return (posix(path) == root) | posix(path).startswith(root.rstrip("/") + "/")


def same_file(a: Column, b: Column) -> Column:
    clean = lambda x: F.lower(F.regexp_replace(F.regexp_replace(posix(x), "/(\\./)+|/+", "/"), "/$", ""))
    return F.coalesce(clean(a) == clean(b), F.lit(False))


def original(folder: Column, file: Column) -> Column:
    return F.concat_ws("/", folder, F.lit(ORIGINALS), file)


def in_repository(identifier: Column, prefix: str = "") -> Column:
    """The path that an artefact has in a repository."""
    name = F.when(F.lower(identifier).endswith(ARTEFACT), identifier).otherwise(F.concat(identifier, F.lit(ARTEFACT)))
    return F.concat(F.lit(prefix), F.regexp_replace(posix(name), "^/+", ""))


def expected(subfolder: Column, name: Column) -> Column:
    """Where an artefact is expected below the root."""
    return F.concat_ws("/", F.nullif(subfolder, F.lit("")), F.concat(name, F.lit(ARTEFACT)))


def unquoted(x: Column) -> Column:
    """Without a pair of quotes around it."""
    text = F.trim(x)
    return F.regexp_replace(text, r"""^(["'])(.*)\1$""", "$2")


def version_of(text: Column) -> Column:
    """The version that a module's text gives; null without any."""
    return F.nullif(F.regexp_extract(text, r"""(?m)^__version__\s*=\s*["']([^"']+)["']""", 1), F.lit(""))


def cover_name(x: Column) -> Column:
    """The base name of a cover; dots alone and null are no name."""
    name = base(F.coalesce(x, F.lit("")))
    return F.when(name.isin("", ".", ".."), "").otherwise(name)


def file_name(x: Column) -> Column:
    """A name that is safe to write; an error for one that isn't, a name of dots say."""
    name = base(F.coalesce(x, F.lit("")))
    bad = name.isin("", ".", "..") | name.contains("\0")
    return F.when(bad, F.raise_error(F.concat(F.lit("not a file name: "), F.coalesce(x, F.lit("null")))).cast("string")).otherwise(name)


def last_characters(x: Column, n: int = 500) -> Column:
    return F.right(x, F.lit(n))


def flag(x: Column) -> Column:
    """A boolean given as text."""
    return F.lower(F.trim(F.coalesce(x, F.lit("")))).isin("1", "true", "yes", "on")


def command(program: Column, flags: list[tuple[str, Column]], switches: list[tuple[str, Column]]) -> Column:
    """The words of a command line: flags with values that aren't empty, then switches that are on, in order."""
    pairs = [F.when(F.coalesce(v, F.lit("")) != "", F.array(F.lit(k), v)).otherwise(F.array().cast("array<string>")) for k, v in flags]
    on = [F.when(F.coalesce(v, F.lit(False)), F.array(F.lit(k))).otherwise(F.array().cast("array<string>")) for k, v in switches]
    return F.flatten(F.array(F.array(program), *pairs, *on))


def dimensions(w: Column, h: Column, scale: Column) -> Column:
    """Both sides scaled and rounded half to even, one pixel at least."""
    side = lambda x: F.greatest(F.lit(1), F.bround(x * scale).cast("long"))
    return F.struct(side(w).alias("w"), side(h).alias("h"))


def fingerprint(size: Column, modified: Column, content: Column) -> Column:
    return F.struct(size.alias("size"), modified.alias("mtime"), F.sha2(content, 256).alias("sha256"))


def root_of(config: Column, key: str, default: str, below: str = "") -> Column:
    """A folder of the settings, the default where it is blank, without a slash at its end, and what is below it."""
    given = F.nullif(F.regexp_replace(posix(F.trim(F.coalesce(F.try_element_at(config, F.lit(key)), F.lit("")))), "/+$", ""), F.lit(""))
    return F.concat(F.coalesce(given, F.lit(default)), F.lit(f"/{below}" if below else ""))


def short_label(x: Column, most: int = 28) -> Column:
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most - 1), F.lit("…"))).otherwise(x)


def media_name(x: Column) -> Column:
    return X.media_kind(x).isNotNull()
