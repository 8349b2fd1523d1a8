"""N-gram Jaccard join by T-occurrence search with DivideSkip, and the components of its links.

A document of n shingles can only be linked with one that shares T = ceil(0.75 n) of them. Of its n inverted
lists the T - 1 longest may be put aside (DivideSkip): a partner is in one of the n - T + 1 shortest, which are
merged, and is then probed for in the long ones by binary search, until it reaches the overlap that both sizes
ask for or can't any more. The steps, none of which holds a list, a group of copies or a component in one task:

1. Counting. Documents are read in chunks; of half of all shingles (by a bit of their hash) each chunk sends those
   it has, once each, to the slice of the hash range they belong to, as packed arrays. The slices say which ones
   other chunks have too. A document too few of whose shingles are shared has no partner and is done: if s of n are
   in the half, a partner shares at least T - (n - s) of them.
2. Lists. What is left, one text per class of equal word sequences, is counted again over all its shingles, now
   for the lengths of the lists, and every document orders its shingles from the shortest list to the longest.
3. Merging. The shortest lists are cut into parts of about PART entries by a hash of the document. In each part,
   and among the first entries of the parts, every document is paired with the one before it and with the first:
   as many pairs as entries, whatever the length. Pairs are probed and links joined to components.
4. The rest. Pairs in a list are open only if their documents are still in different components; those are
   probed too, so no link between different texts is missed. A list of one component, such as that of a large group
   of near copies, has none.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, bounded_batches, checkpointed, frugal, frugal_group, heavy_split, text_of, unused
from .components import components

#: Words of a shingle, and the similarity in percent from which two documents are linked.
WORDS, PERCENT = 5, 75
#: Shingles and documents of a chunk; text that one slice of the hash range stands for; entries of a part of a list.
CHUNK, CHUNK_DOCS, SLICE_BYTES, PART = 1_000_000, 32_000, 16 << 20, 256
MANY = 65_535  # instead of a document's number: several documents of the chunk
#: Words remembered by a worker; earlier open lists that an entry names; entries of a list that one task pairs with all others.
REMEMBERED, EARLIER, SIDE = 100_000, 64, 4096


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:  # a cache of long words would have no bound in bytes
            if len(self) > REMEMBERED:
                self.clear()
            self[word] = value
        return value


def shingles(text: str, hashes: WordHashes, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles."""
    split = text.encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not split:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(hashes.__getitem__, split), np.uint64, len(split))
    n = min(words, len(ids))
    with np.errstate(over="ignore"):
        h = np.full(len(ids) - n + 1, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - n + 1 + k]
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def least_overlap(n: np.ndarray | int, percent: int = PERCENT):
    return -(-percent * n // 100)


def slice_of(values: np.ndarray, slices: int) -> np.ndarray:
    """The slices of the hash range that hashes belong to; they ascend with the hashes."""
    return ((values >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)


def start_of(slice_no: int, slices: int) -> int:
    """The smallest hash of a slice."""
    return -(-(slice_no << 32) // slices) << 32


def packed(part: np.ndarray, start: int) -> bytes:
    """40 bits of each hash behind the start of its slice: enough to count by, as it only errs to the safe side."""
    short = (part - np.uint64(start)) >> np.uint64(8)
    return (short & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (short >> np.uint64(32) & np.uint64(0xFF)).astype(np.uint8).tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    n = len(blob) // 5
    return np.frombuffer(blob, "<u4", n).astype(np.uint64) | np.frombuffer(blob, np.uint8, n, 4 * n).astype(np.uint64) << np.uint64(32)


SENT = "slice long, chunk long, hashes binary, which binary, head binary"


def cuts(values: np.ndarray, slices: int) -> list[tuple[int, int, int]]:
    """(slice, from, to) of sorted hashes, for the slices that have any."""
    if not len(values):
        return []
    at = slice_of(values, slices)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return list(zip(at[first].tolist(), first.tolist(), [*first[1:].tolist(), len(values)], strict=True))


def send(chunk: int, values: np.ndarray, which: np.ndarray, head, slices: int) -> pa.RecordBatch:
    """A chunk's rows to the slices, and its head, which only the chunk needs again, as a row of its own.

    A head's key is a negative number that no other row has, so heads spread over all tasks like slices.
    """
    rows = cuts(values, slices)
    return pa.RecordBatch.from_arrays([
        pa.array([k for k, *_ in rows] + [-1 - chunk], pa.int64()), pa.array([chunk] * (len(rows) + 1), pa.int64()),
        pa.array([packed(values[a:b], start_of(k, slices)) for k, a, b in rows] + [b""], pa.binary()),
        pa.array([which[a:b].tobytes() for _, a, b in rows] + [b""], pa.binary()),
        pa.array([None] * len(rows) + [pickle.dumps(head)], pa.binary()),
    ], names=["slice", "chunk", "hashes", "which", "head"])


def in_chunks(batches, columns: list[str], count):
    """Lists of rows with at most about CHUNK of what `count` counts, with the chunk's number."""
    part = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
    rows, size = [], 0
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
            row = (*row[:-1], count(row[-1]))
            rows.append(row)
            size += len(row[-1])
            if size >= CHUNK or len(rows) >= CHUNK_DOCS:
                yield part, rows
                part, rows, size = part + 1, [], 0
    if rows:
        yield part, rows


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that sorts the values, where its runs start, and their lengths."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    first = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.empty(0, int)
    return order, first, np.diff(np.append(first, len(v)))


def slice_values(table: pa.Table):
    """Of a slice's rows: chunk by row, all values and the row of each."""
    blobs = [x.as_py() for x in table.column("hashes")]
    parts = [unpacked(b) for b in blobs]
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    return table.column("chunk").to_numpy(), np.concatenate(parts) if parts else np.empty(0, np.uint64), row


# Step 1.


def first_count(keyed: DataFrame, slices: int) -> DataFrame:
    """doc_id, digest, n and `open` (it may have a partner) of every document."""

    @frugal
    def read(batches):
        hashes = WordHashes()
        for chunk, rows in in_chunks(batches, ["doc_id", "digest", "text"], lambda t: shingles(t, hashes)):
            seen, halves = set(), []
            for _, digest, h in rows:
                halves.append(np.empty(0, np.uint64) if digest in seen else h[h & np.uint64(1) == 1])
                seen.add(digest)
            values = np.concatenate(halves)
            which = np.repeat(np.arange(len(rows)), [len(h) for h in halves])
            order, first, length = runs(values)
            many = np.repeat(length > 1, length)
            local = np.bincount(which[order][many], minlength=len(rows))
            one = np.where(length > 1, MANY, which[order][first]).astype("<u2")
            head = (
                [i for i, *_ in rows], [d for _, d, _ in rows], np.array([len(h) for *_, h in rows]),
                np.array([len(h) for h in halves]), local,
            )
            yield send(chunk, values[order][first], one, head, slices)

    @frugal_group
    def count(table: pa.Table) -> pa.Table:
        chunk, values, row = slice_values(table)
        which = np.concatenate([np.frombuffer(x.as_py(), "<u2") for x in table.column("which")])
        order, _, length = runs(values)
        shared = order[np.repeat(length > 1, length)]
        shared = shared[which[shared] != MANY]
        key, n = np.unique(row[shared] << 16 | which[shared], return_counts=True)
        at = np.searchsorted(key >> 16, np.arange(table.num_rows + 1))
        which, n = (key & MANY).astype("<u2"), n.astype("<u4")
        cut = list(zip(at, at[1:], strict=False))
        return pa.table({
            "chunk": chunk, "which": pa.array([which[a:b].tobytes() for a, b in cut], pa.binary()),
            "n": pa.array([n[a:b].tobytes() for a, b in cut], pa.binary()), "head": table.column("head").cast(pa.binary()),
        })

    @frugal_group
    def finish(table: pa.Table) -> pa.Table:
        ids, digests, n, half, shared = pickle.loads(next(x.as_py() for x in table.column("head") if x.is_valid))
        shared = shared.copy()
        for which, count in zip(table.column("which"), table.column("n"), strict=True):
            shared[np.frombuffer(which.as_py(), "<u2")] += np.frombuffer(count.as_py(), "<u4")
        may = (n > 0) & (shared >= least_overlap(n) - (n - half))
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "digest": pa.array(digests, pa.binary()),
            "n": pa.array(n, pa.int64()), "open": pa.array(may, pa.bool_()),
        })

    sent = keyed.select("doc_id", "digest", "text").mapInArrow(read, SENT)
    counted = sent.groupBy("slice").applyInArrow(count, "chunk long, which binary, n binary, head binary")
    return counted.groupBy("chunk").applyInArrow(finish, "doc_id long, digest binary, n long, open boolean")


# Step 2.


def shared_lists(texts: DataFrame, slices: int) -> DataFrame:
    """node, n, shared (hashes from the shortest list to the longest) and lengths (of the lists to be merged)."""

    @frugal
    def read(batches):
        hashes = WordHashes()
        for chunk, rows in in_chunks(batches, ["digest", "text"], lambda t: shingles(t, hashes)):
            values, count = np.unique(np.concatenate([h for _, h in rows]), return_counts=True)
            yield send(chunk, values, count.astype("<u4"), rows, slices)

    @frugal_group
    def count(table: pa.Table) -> pa.Table:
        chunk, values, row = slice_values(table)
        n = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table.column("which")])
        order, first, length = runs(values)
        total = np.empty(len(values), np.int64)
        total[order] = np.repeat(np.add.reduceat(n[order].astype(np.int64), first), length) if len(first) else 0
        cut = np.searchsorted(row, np.arange(table.num_rows + 1))
        out, where = [], []
        for a, b in zip(cut, cut[1:], strict=False):
            several = np.flatnonzero(total[a:b] > 1)
            where.append(several.astype("<u4").tobytes())
            out.append(total[a:b][several].astype("<u4").tobytes())
        return pa.table({
            "slice": table.column("slice"), "chunk": chunk, "at": pa.array(where, pa.binary()),
            "n": pa.array(out, pa.binary()), "head": table.column("head").cast(pa.binary()),
        })

    @frugal_group
    def finish(table: pa.Table) -> pa.Table:
        rows = pickle.loads(next(x.as_py() for x in table.column("head") if x.is_valid))
        values = np.unique(np.concatenate([h for _, h in rows]))
        begin = {k: a for k, a, _ in cuts(values, slices)}
        length = np.ones(len(values), np.int64)
        for k, at, n in zip(*(table.column(c) for c in ("slice", "at", "n")), strict=True):
            if k.as_py() >= 0:
                length[begin[k.as_py()] + np.frombuffer(at.as_py(), "<u4").astype(int)] = np.frombuffer(n.as_py(), "<u4")
        nodes, sizes, shared, lengths = [], [], [], []
        for node, h in rows:
            own = length[np.searchsorted(values, h)]
            order = np.lexsort((h, own))
            alone, merged = int((own == 1).sum()), len(h) - least_overlap(len(h)) + 1
            if merged > alone:
                nodes.append(node), sizes.append(len(h))
                shared.append(h[order][alone:].view(np.int64))
                lengths.append(own[order][alone:merged])
        return pa.table({
            "node": pa.array(nodes, pa.binary()), "n": pa.array(sizes, pa.int64()),
            "shared": pa.array(shared, pa.list_(pa.int64())), "lengths": pa.array(lengths, pa.list_(pa.int64())),
        })

    counted = texts.mapInArrow(read, SENT).groupBy("slice").applyInArrow(
        count, "slice long, chunk long, at binary, n binary, head binary")
    return counted.groupBy("chunk").applyInArrow(finish, "node binary, n long, shared array<long>, lengths array<long>")


# Steps 3 and 4.


def ordered(a, b):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def reachable(p: str, q: str, percent: int = PERCENT):
    """Whether two documents whose first common shingle is at places `at` of `n` can still reach the overlap.

    Places count from 0 in the order from the shortest list to the longest, those of unshared shingles included. At
    later common shingles the bound is too low, but a pair only has to be found at its first.
    """
    left = F.least(F.expr(f"{p}.n - {p}.at"), F.expr(f"{q}.n - {q}.at"))
    return left * (100 + percent) >= F.expr(f"({p}.n + {q}.n) * {percent}")


def first_pairs(entries: DataFrame, longest: int) -> DataFrame:
    """Pairs of the documents of a part of a list with the one before them and the first two; the first of each part stands
    for it in a part of the next level, until a level has one part. `longest` is the length of the longest list.

    Documents with the fewest shingles of their own come first: in a group of near copies, those from which most
    others differ least.
    """

    def linked(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy("list", "part").orderBy("x")
        met = rows.select("x", F.lag("x").over(w).alias("before"), F.first("x").over(w).alias("one"), F.nth_value("x", 2).over(w).alias("two"))
        pairs = met.where("before IS NOT NULL").select("x", F.explode(F.array_distinct(F.array("before", "one", "two"))).alias("y"))
        return pairs.where("y IS NOT NULL AND x.node <> y.node").where(reachable("x", "y")).select(*ordered(F.col("x.node"), F.col("y.node")))

    parts = entries.withColumn("parts", F.ceil(F.col("length") / PART))
    rows = parts.select("list", F.pmod(F.xxhash64("node"), "parts").alias("part"), "parts", F.struct("alone", "node", "n", "at").alias("x"))
    found = linked(rows)
    while longest > PART:
        longest = -(-longest // PART)
        heads = rows.where("parts > 1").groupBy("list", "part", "parts").agg(F.min("x").alias("x"))
        fewer = F.ceil(F.col("parts") / PART)
        rows = heads.select("list", F.pmod(F.xxhash64("x.node"), fewer).alias("part"), fewer.alias("parts"), "x")
        found = found.unionByName(linked(rows))
    return found.distinct()


def probe(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that are linked."""
    side = lambda s: sets.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("shared").alias(f"set_{s}"))

    @frugal
    def run(batches):
        for b in batches:
            keep, last, right = [], None, None
            for x, y, n, m, p, q in zip(*(b.column(c) for c in ("a", "b", "n_a", "n_b", "set_a", "set_b")), strict=True):
                if y.as_py() != last:
                    last, right = y.as_py(), np.sort(q.values.to_numpy())
                left = p.values.to_numpy()
                both = n.as_py() + m.as_py()
                need = -(-PERCENT * both // (100 + PERCENT))
                found = 0
                if min(len(left), len(right)) >= need:
                    for k in range(0, len(left), 512):  # until it can't be reached any more
                        part = left[k : k + 512]
                        at = np.minimum(np.searchsorted(right, part), len(right) - 1)
                        found += int((right[at] == part).sum())
                        if found >= need or found + len(left) - k - len(part) < need:
                            break
                keep.append(found >= need)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(mask), b.column("b").filter(mask)], names=["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a binary, b binary")


def links(sets: DataFrame) -> DataFrame:
    """Links that connect all documents that are connected: (a, b) of nodes."""
    merged = F.posexplode(F.arrays_zip(F.expr("slice(shared, 1, size(lengths))").alias("list"), "lengths")).alias("k", "x")
    alone = (F.col("n") - F.size("shared")).alias("alone")
    entries = sets.select("node", "n", alone, merged).select(
        "node", "n", "alone", (F.col("alone") + F.col("k")).alias("at"), F.col("x.list").alias("list"), F.col("x.lengths").alias("length"))
    longest = sets.select(F.max(F.array_max("lengths"))).first()[0] or 0
    tried = checkpointed(first_pairs(entries, longest))
    found = checkpointed(probe(tried, sets))
    roots = components(found)
    placed = checkpointed(entries.join(roots, "node", "left").select("list", "node", "n", "at", F.coalesce("root", "node").alias("root")))
    mixed = placed.groupBy("list").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("m")).where("low <> high")
    sides = F.ceil(F.col("m") / SIDE)
    own = Window.partitionBy("node").orderBy("at").rowsBetween(-EARLIER, -1)
    rest = placed.join(mixed.select("list", sides.alias("sides")), "list").withColumn("before", F.collect_list("list").over(own))
    rest = checkpointed(rest)
    # One side of a long list is dealt to several tasks, the other goes to each of them.
    p = rest.withColumn("side", F.pmod(F.xxhash64("node"), "sides")).alias("p")
    q = rest.withColumn("side", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1))).alias("q")
    # A pair counts in its first list; where more than EARLIER lists come before, it may be found again, hence distinct().
    first = ~F.arrays_overlap("p.before", "q.before")
    apart = (F.col("p.list") == F.col("q.list")) & (F.col("p.side") == F.col("q.side")) & (F.col("p.root") < F.col("q.root"))
    open_pairs = p.join(q, apart & reachable("p", "q") & first).select(*ordered(F.col("p.node"), F.col("q.node"))).distinct()
    open_pairs = open_pairs.join(tried, ["a", "b"], "left_anti")
    return found.unionByName(checkpointed(probe(open_pairs, sets)))


def normal_digest(text_col: str):
    """16 bytes that equal sequences of lower-cased words share."""
    lower = F.translate(text_of(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.unhex(F.substring(F.sha2(F.trim(F.regexp_replace(lower, SPACE, " ")), 256), 1, 32))


def joined(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """doc_id, digest, n of every row, and of every digest with words: digest, copies, n_shingles, rep (smallest identifier
    of its rows) and group (the digest that stands for its component)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    text = text_of(text_col)
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), normal_digest(text_col).alias("digest"), text.alias("text"))
    size = docs.select(F.sum(F.octet_length(text))).first()[0] or 0
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SLICE_BYTES)

    seen = checkpointed(first_count(keyed, slices))
    classes = checkpointed(seen.groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("n").alias("n_shingles"), F.max("open").alias("open")))
    chosen = classes.where("open").select(F.col("digest").alias("_d"), "rep")
    same = (keyed["digest"] == chosen["_d"]) & keyed["doc_id"].eqNullSafe(chosen["rep"])
    sets = checkpointed(shared_lists(keyed.join(chosen, same, "left_semi").select("digest", "text"), slices))
    sets = checkpointed(sets.groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "shared", "lengths")))) if repeated(classes, seen) else sets
    roots = components(links(sets))
    placed = classes.where("n_shingles > 0").join(roots.withColumnRenamed("node", "digest"), "digest", "left")
    return seen, checkpointed(placed.select("digest", "copies", "n_shingles", "rep", F.coalesce("root", "digest").alias("group")))


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    A text of fewer than WORDS words is one shingle as a whole; one without words, or null, has none and is linked
    with nothing. component_id is the smallest identifier that links lead to; rows without identifier take part and
    have a null one only where no other row of the component has one. Repeated rows are alike. Texts of any length
    are read whole, an empty table gives an empty result, and other columns of `docs` are not read.
    """
    seen, placed = joined(docs, id_col, text_col)
    smallest = checkpointed(placed.groupBy("group").agg(F.min("rep").alias("component_id"), F.count("*").alias("_m")))
    known = heavy_split(placed, smallest, "group", "_m", placed.count()).select("digest", "copies", "n_shingles", "component_id")
    full = seen.where("n > 0").select("doc_id", "digest")
    linked = heavy_split(full, known, "digest", "copies", seen.count())
    empty = seen.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.select("doc_id", "n_shingles", "component_id").unionByName(empty)


def repeated(classes: DataFrame, seen: DataFrame) -> bool:
    """Whether some class's first row comes more than once, so that its text was read more than once."""
    twice = seen.groupBy("digest", "doc_id").agg(F.count("*").alias("n")).where("n > 1")
    first = classes.where("open AND copies > 1").select("digest", F.col("rep").alias("doc_id"))
    same = (twice["digest"] == first["digest"]) & twice["doc_id"].eqNullSafe(first["doc_id"])
    return not twice.join(first, same, "left_semi").isEmpty()


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component stays, that with the smallest identifier (null last), and all without words.

    Columns keep their names and values, whatever they are called. Of rows that repeat an identifier and a text one
    stays. An empty table gives an empty result.
    """
    seen, placed = joined(docs, id_col, text_col)
    order = F.struct(F.col("rep").isNull().alias("none"), "rep", "digest")
    first = checkpointed(placed.groupBy("group").agg(F.min(order).alias("x")).select(F.col("x.digest").alias("digest"), F.col("x.rep").alias("rep")))
    d, i, k = (unused(docs, c) for c in ("digest", "id", "nth"))
    chosen = first.select(F.col("digest").alias(d), F.col("rep").alias(i))
    words = docs.where(F.regexp_count(text_of(text_col), F.lit(WORD)) > 0).withColumn(d, normal_digest(text_col))
    same = (words[d] == chosen[d]) & words[id_col].cast("long").eqNullSafe(chosen[i])
    kept = words.join(chosen, same, "left_semi")
    rows = seen.join(first, (seen["digest"] == first["digest"]) & seen["doc_id"].eqNullSafe(first["rep"]), "left_semi")
    if rows.count() > first.count():  # some row repeats both, so one of them has to be told apart
        kept = kept.withColumn(k, F.row_number().over(Window.partitionBy(id_col, d).orderBy(id_col))).where(F.col(k) == 1)
    return kept.select(*docs.columns).unionByName(docs.where(F.regexp_count(text_of(text_col), F.lit(WORD)) == 0))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) END AS grams FROM d
), n AS (SELECT doc_id, len(grams) AS n FROM g),
s AS (SELECT doc_id, hash(unnest(grams)) AS gram FROM g),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS doc_id, b AS other FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT n.doc_id, n.n AS n_shingles, coalesce(least(n.doc_id, m.low), n.doc_id) AS component_id
FROM n LEFT JOIN (SELECT doc_id, min(other) AS low FROM r GROUP BY 1) m USING (doc_id)
"""
