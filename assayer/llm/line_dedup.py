"""Line deduplication by pairwise alignment.

Lines are hashed. Every line that several documents have leads from each of them to the first one (in the order
of identifiers) that has it; rare lines are in few documents, so their pairs are few, and a line that is in very many
gives no more pairs than documents, whatever its number. The shared lines of both documents of a pair are then
aligned by patience diff: lines that are unique in both and keep their order are anchors, between which the same is
done again, and equal lines next to anchors are taken in. Runs of aligned lines that follow each other in both
documents are blocks; blocks of MIN_WORDS words or more are deleted from the later document. The first document
that has a line is never the later one of its pairs, so one copy of every line stays.

Two later documents may share a block whose lines each came first in documents of their own. With `runs`, the
shortest runs of shared lines that hold MIN_WORDS words lead to their own first holders as well, and are anchors of
the pair, so that a block that is elsewhere in the first holder is found too: every block that an alignment with any
earlier document finds is made of such runs. Pairs stay as many as lines at most.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, bounded_batches, checkpointed, frugal, heavy_split, in_parts, text_of

#: Words of the smallest block that is deleted; pairs that one task joins with the lines of their first document.
MIN_WORDS, SIDE = 10, 4096


def increasing(places: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by patience sorting."""
    tops, piles, before = [], [], [-1] * len(places)
    for k, p in enumerate(places):
        at = bisect_left(tops, p)
        before[k] = piles[at - 1] if at else -1
        tops[at : at + 1], piles[at : at + 1] = [p], [k]
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of places of equal lines, increasing in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        times: dict[int, list[int]] = {}
        for x in a[i:m]:
            times.setdefault(x, [0, 0, 0])[0] += 1
        for k in range(j, n):
            if b[k] in times:
                t = times[b[k]]
                t[1], t[2] = t[1] + 1, k
        unique = [(k, times[a[k]][2]) for k in range(i, m) if times[a[k]][:2] == [1, 1]]
        anchors = [unique[k] for k in increasing([y for _, y in unique])]
        if not anchors:
            continue
        out += anchors
        ends = [(i - 1, j - 1), *anchors, (m, n)]
        todo += [(x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(ends, ends[1:], strict=False)]
    return sorted(out)


def blocks(first: list[tuple[int, int, int]], later: list[tuple[int, int, int]], least: int) -> list[int]:
    """Places of the later document's lines to delete; documents are lists of (place, hash, words) of shared lines."""
    found, run, words, before = [], [], 0, None
    for x, y in align([h for _, h, _ in first], [h for _, h, _ in later]):
        here = first[x][0], later[y][0]
        if before is None or here != (before[0] + 1, before[1] + 1):
            found += run if words >= least else []
            run, words = [], 0
        run, words, before = [*run, here[1]], words + later[y][2], here
    return found + (run if words >= least else [])


def shortest_runs(lines: list[tuple[int, int, int]], least: int) -> dict[tuple[int, ...], list[int]]:
    """The runs of lines that follow each other and hold `least` words, but wouldn't without their first or their last line.

    Gives the places of each by its hashes, of runs that repeat those of all. Lines are (place, hash, words).
    """
    out: dict[tuple[int, ...], list[int]] = {}

    def add(at: int, to: int) -> None:
        out.setdefault(tuple(h for _, h, _ in lines[at:to]), []).extend(p for p, _, _ in lines[at:to])

    stretch = 0
    while stretch < len(lines):
        end = stretch + 1
        while end < len(lines) and lines[end][0] == lines[end - 1][0] + 1:
            end += 1
        at, words = stretch, 0
        for to in range(stretch, end):  # the shortest that end here
            words += lines[to][2]
            while words - lines[at][2] >= least and at < to:
                words, at = words - lines[at][2], at + 1
            if words >= least and lines[to][2]:
                add(at, to + 1)
        at, words = end - 1, 0
        for start in range(end - 1, stretch - 1, -1):  # the shortest that start here
            words += lines[start][2]
            while words - lines[at][2] >= least and at > start:
                words, at = words - lines[at][2], at - 1
            if words >= least and lines[start][2]:
                add(start, at + 1)
        stretch = end
    return out


def anchored(first: list[tuple[int, int, int]], later: list[tuple[int, int, int]], least: int) -> list[int]:
    """The places of blocks(), and those of the shortest runs that both documents have, wherever they are."""
    held, found = shortest_runs(first, least), set(blocks(first, later, least))
    return sorted(found.union(*(places for run, places in shortest_runs(later, least).items() if run in held)))


def run_pairs(lists: DataFrame, least: int) -> DataFrame:
    """Pairs (first, row) of the first holder of each shortest run and every later document that has it."""

    @frugal
    def run(batches):
        for b in in_parts(batches):
            keys = [
                [int.from_bytes(hashlib.blake2b(array("q", k), digest_size=8).digest(), "little", signed=True) for k in
                 shortest_runs([tuple(y.values()) for y in x.as_py()], least)] for x in b.column("lines")]
            columns = [b.column(c) for c in ("row", "doc_id", "digest")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(keys, pa.list_(pa.int64()))], names=["row", "doc_id", "digest", "runs"])

    found = lists.select("row", "doc_id", "digest", "lines").mapInArrow(run, "row long, doc_id long, digest binary, runs array<long>")
    found = checkpointed(found.select("row", "doc_id", "digest", F.explode("runs").alias("run")))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "row")
    met = found.groupBy("run").agg(F.min(order).alias("low"), F.max(order).alias("high"), F.count("*").alias("times"))
    firsts = checkpointed(met.where("low.row <> high.row").select("run", F.col("low.row").alias("first"), "times"))
    return heavy_split(found.select("row", "run"), firsts, "run", "times", found.count()).where("first <> row").select("first", "row")


def with_first(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """(row, a): the lines of the first document beside each later one. A first document of many pairs goes to several tasks."""
    known = checkpointed(pairs.groupBy("first").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / SIDE)))
    dealt = heavy_split(pairs, known, "first", "n", pairs.count()).withColumn("part", F.pmod(F.xxhash64("row"), "parts"))
    held = lists.select(F.col("row").alias("first"), F.col("lines").alias("a")).join(known, "first")
    held = held.select("first", "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    return dealt.join(held, ["first", "part"]).select("row", "a")


def deletions(docs: DataFrame, least: int = MIN_WORDS, runs: bool = False) -> DataFrame:
    """row, doc_id, digest, nth and removed (places, null if none) of rows (doc_id, text)."""
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))  # before lines are rows
    # After its lines each document has one row more, with the digest of its text; its lines only carry the digest's beginning.
    split = F.posexplode(F.array_append(F.split("text", "\n"), F.lit(None).cast("string"))).alias("place", "line")
    rows = rows.select("doc_id", "row", F.unhex(F.sha2("text", 256)).alias("digest"), split)
    whole = F.col("line").isNull()
    lines = checkpointed(rows.where(whole | (F.trim("line") != "")).select(
        "row", "doc_id", F.when(whole, F.col("digest")).otherwise(F.substring("digest", 1, 8)).alias("digest"), F.when(~whole, F.col("place")).alias("place"),
        F.xxhash64("line").alias("hash"), F.regexp_count("line", F.lit(WORD)).alias("words")))
    full = lines.where("place IS NOT NULL")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "row")
    met = full.groupBy("hash").agg(F.min(order).alias("low"), F.max(order).alias("high"), F.count("*").alias("times"))
    firsts = checkpointed(met.where("low.row <> high.row").select("hash", F.col("low.row").alias("first"), "times"))
    shared = checkpointed(heavy_split(full, firsts, "hash", "times", full.count()).select("row", "doc_id", "digest", "place", "hash", "words", "first"))
    pairs = shared.where("first <> row").select("first", "row").distinct()
    lines_of = F.sort_array(F.collect_list(F.struct("place", "hash", "words"))).alias("lines")
    lists = checkpointed(shared.groupBy("row").agg(F.min("doc_id").alias("doc_id"), F.min("digest").alias("digest"), lines_of))
    if runs:
        pairs = pairs.unionByName(run_pairs(lists, least)).distinct()
    compared = anchored if runs else blocks
    both = with_first(checkpointed(pairs), lists).join(lists.select("row", "lines"), "row")

    @frugal
    def run(batches):
        for b in in_parts(batches, 64):
            tuples = lambda x: [tuple(y.values()) for y in x.as_py()]
            out = [compared(tuples(x), tuples(y), least) for x, y in zip(b.column("a"), b.column("lines"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(out, pa.list_(pa.int32()))], names=["row", "removed"])

    removed = both.select("row", "a", "lines").mapInArrow(run, "row long, removed array<int>").where("size(removed) > 0")
    removed = removed.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("removed"))).alias("removed"))
    known = lines.where("place IS NULL").select("row", "doc_id", "digest")
    same = Window.partitionBy("doc_id", "digest").orderBy("row")
    return known.withColumn("nth", F.row_number().over(same)).join(removed, "row", "left")


def line_dedup(docs: DataFrame, least: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", runs: bool = False) -> DataFrame:
    """doc_id, text (without the deleted lines), n_lines, n_removed and removed (places from 0) of every row.

    Lines end at "\\n"; blank ones are never deleted. Documents are ordered by identifier (null last), then by text; of
    rows that repeat, one counts as the first. A null text counts as one empty line. Texts of any length are read whole, an
    empty table gives an empty result, and other columns, whatever their names, are not read.
    With `runs`, documents meet the first holders of shared runs too, not only those of single lines.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    found = deletions(rows, least, runs).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.col("nth").alias("_nth"), "removed")
    keyed = rows.withColumn("_d", F.unhex(F.sha2("text", 256)))
    keyed = keyed.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id", "_d").orderBy("doc_id")))
    same = keyed["doc_id"].eqNullSafe(found["_id"]) & (keyed["_d"] == found["_digest"]) & (keyed["_k"] == found["_nth"])
    # The lines come first as a column of their own: within the function for each place the text would be split for every line.
    both = keyed.join(found, same).select("doc_id", "text", "removed", F.split("text", "\n").alias("_lines"))
    gone = F.coalesce("removed", F.array().cast("array<int>"))
    places = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "removed")  # by hashing: linear in the lines
    left = F.array_join(F.transform(places, lambda k: F.get("_lines", k)), "\n")
    return both.select(
        "doc_id", F.when(F.col("removed").isNull(), F.col("text")).otherwise(left).alias("text"), F.size("_lines").alias("n_lines"),
        F.size(gone).alias("n_removed"), F.sort_array(gone).alias("removed"))


def line_report(docs: DataFrame) -> DataFrame:
    """The result as digests: doc_id, n_lines, n_removed, removed, text_sha256."""
    return line_dedup(docs, runs=True).select("doc_id", "n_lines", "n_removed", "removed", F.sha2("text", 256).alias("text_sha256"))
