"""Job logs: typed extraction from lines and the state a job has reached."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



@dataclass(frozen=True)
class Patterns:
    """Formats of the lines that a job writes: texts that a line contains, and expressions."""

    error: str = "[studio] error"
    loading: str = "loading VAE"
    media: str = r"\[extract\] (image|video) (.+):"
    identity: str = r"\[\w+\] identity (\d+)/(\d+)"
    cap: str = "token cap"
    saved: str = r"saved \S+ mod '([^']+)' \((\d+) tokens, ([\d.]+) MB\) -> (.+)$"


#: The formats of the jobs at hand, statuses of a job that has ended, and what is known before its first line.
LINES = Patterns()
ENDED = {"done": ("saved", 100), "error": ("error", 0)}
UNKNOWN = {"stage": "starting", "encoded": 0, "kind": "image", "current": "", "step": 0, "steps": 0}


def stage(line: Column, patterns: Patterns = LINES) -> Column:
    """What a line says of the stage, the first that fits; null if nothing."""
    return (
        F.when(line.contains(patterns.error), "error").when(line.contains(patterns.loading), "loading_vae").when(line.rlike(patterns.media), "encoding")
        .when(line.rlike(patterns.identity), "refining").when(line.contains(patterns.cap), "fitting").when(line.rlike(patterns.saved), "saved")
    )


def saved(lines: DataFrame, patterns: Patterns = LINES) -> DataFrame:
    """name, token_count, mb and path of lines that say so."""
    part = lambda k: F.regexp_extract("line", patterns.saved, k)
    return lines.where(F.col("line").rlike(patterns.saved)).withColumns(
        {"name": part(1), "token_count": part(2).cast("long"), "mb": part(3).cast("double"), "path": F.trim(part(4))})


def percent(stage: Column, encoded: Column, total: Column, step: Column, steps: Column) -> Column:
    """How far a job is, in whole percent (rounded down)."""
    all_files = F.greatest(total, F.lit(1))
    base = 8 + F.floor(84 * F.greatest(encoded - 1, F.lit(0)) / all_files)
    share = F.when(steps > 0, step / steps).otherwise(0.0)
    return (
        F.when(stage == "starting", 1).when(stage == "loading_vae", 6)
        .when(stage == "encoding", F.least(F.lit(92), 8 + F.floor(84 * encoded / F.greatest(total, encoded, F.lit(1)))))
        .when(stage == "refining", F.least(F.lit(96), base + F.floor(84 / all_files * share)))
        .when(stage == "fitting", 96).when(stage == "saved", 100).otherwise(0).cast("long")
    )


def ended(rows: DataFrame) -> DataFrame:
    """Stage and percent as the status of a job (running, done or error) has them: once a job has ended, no line overrules that."""
    over = lambda k, c: F.coalesce(*(F.when(F.col("status") == s, v[k]) for s, v in ENDED.items()), c)
    return rows.withColumns({"stage": over(0, F.col("stage")), "percent": over(1, F.col("percent")).cast("long")})


def progress(lines: DataFrame, totals: DataFrame, job: str = "job", order: str = "line_no", patterns: Patterns = LINES) -> DataFrame:
    """The state of every job of `totals` (job, total, and status if there is one) after its last line: a later line overrules
    an earlier one, an error too; the status of a job that has ended overrules all lines.

    Each figure is the last one that any line gives: a maximum by line number, which Spark folds before it shuffles.
    """
    found = folded(lines, job, order, patterns).drop("lines")
    out = totals.join(found, job, "left").na.fill(UNKNOWN)
    done = percent(F.col("stage"), F.col("encoded"), F.col("total"), F.col("step"), F.col("steps"))
    out = out.withColumn("percent", done).withColumn("total", F.greatest("total", "encoded"))
    return ended(out) if "status" in totals.columns else out


def folded(lines: DataFrame, job: str = "job", order: str = "line_no", patterns: Patterns = LINES) -> DataFrame:
    """What the lines of every job say, and how many they are, without its total; of a stream as well as of a table."""
    line = F.col("line")
    said = lines.withColumn("_s", stage(line, patterns))
    last = lambda value, when: F.max_by(F.when(when, value), F.when(when, F.col(order)))
    media, step = F.col("_s") == "encoding", F.col("_s") == "refining"
    return said.groupBy(job).agg(
        F.coalesce(last(F.col("_s"), F.col("_s").isNotNull()), F.lit("starting")).alias("stage"),
        F.count_if(F.coalesce(media, F.lit(False))).alias("encoded"),
        F.coalesce(last(F.regexp_extract(line, patterns.media, 1), media), F.lit("image")).alias("kind"),
        F.coalesce(last(F.element_at(F.split(F.trim(F.regexp_extract(line, patterns.media, 2)), "/"), -1), media), F.lit("")).alias("current"),
        F.coalesce(last(F.regexp_extract(line, patterns.identity, 1).try_cast("long"), step), F.lit(0)).alias("step"),
        F.coalesce(last(F.regexp_extract(line, patterns.identity, 2).try_cast("long"), step), F.lit(0)).alias("steps"),
        F.count("*").alias("lines"))
