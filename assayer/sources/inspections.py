"""Inspections of files that are kept: only files that are new or have changed are read again.

What was read of a file is a row of a table in versions, keyed by path, time and size. A refresh joins the files there are with
the last version: rows of files as they are stay, those of files that have changed or gone are retired, and only what is left of
the files is inspected. Where nothing is retired the new rows are added beside the old ones, else the table is written anew; both
are published at once, and a refresh that another one overtook is repeated on its result.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sinks import versions
from ..sinks.places import checkpointed

#: What tells whether a file is as it was.
KEY = ("path", "modified", "size")


def refreshed(files: DataFrame, path: str, inspect: Callable[[DataFrame], DataFrame], key: tuple[str, ...] = KEY) -> DataFrame:
    """The inspections of all files, as the table at `path` has them after this refresh.

    `inspect` gives, for rows of `files` (one per file, with the columns of the key), the same rows with what was read of them; it
    is given only the files that the table doesn't have as they are. Without files the table is empty.
    """
    spark = files.sparkSession
    now = checkpointed(files.select(*key).distinct())  # one listing for all that follows
    for k in range(versions.TRIES):
        base = versions.latest(path)
        table = versions.read(spark, path, base)
        try:
            if table is None:
                versions.publish(inspect(now), path, base)
            else:
                new = inspect(now.join(table.select(*key), list(key), "left_anti"))
                retired = table.join(now, list(key), "left_anti").limit(1).count()
                kept = table.join(now, list(key), "left_semi")
                if retired:
                    versions.publish(kept.select(*table.columns).unionByName(new), path, base, keep=False)
                elif not now.join(table.select(*key), list(key), "left_anti").isEmpty():
                    versions.publish(new.select(*table.columns), path, base)
            return versions.read(spark, path)
        except versions.Conflict:
            time.sleep(0.05 * (k + 1))
    raise versions.Conflict(versions.CONFLICT)


def previews(files: DataFrame, path: str, render: Callable[[DataFrame], DataFrame], side: int, form: int = 1) -> DataFrame:
    """Rendered previews, one per file, side and form: as `refreshed`, with those two in the key, so other ones are rendered anew."""
    keyed = files.withColumns({"side": F.lit(side), "form": F.lit(form)})
    return refreshed(keyed, path, render, (*KEY, "side", "form"))
