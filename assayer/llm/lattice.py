"""Subword lattice likelihood: a unigram vocabulary weighs all segmentations of a text.

The vocabulary is that of an existing model file; its scores, which are ranks, become Zipf weights, and rounds of
expectation over the training documents turn these into probabilities. The forward recursion in log space sums the
weights of all ways to cut a word, its boundary mark included, into pieces, with single bytes as a way for any
character. A boundary mark only starts pieces, so no piece spans two words and the document's marginal probability is
the product of its words' and of the end's: every distinct word is solved once, wherever it occurs, instead of in
every document. Words are counted over all documents; those that are common (their number is bounded) are looked up in
a broadcast table, the others by a join in which, therefore, no word is common.
"""

from __future__ import annotations

import functools
import math
from array import array
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bounded_batches, checkpointed, frugal, id_crc, id_crc_col, text_of

#: Folds are crc32(doc_id) mod FOLDS, of which HELD is not learnt from; the mark of a word's start.
FOLDS, HELD, MARK = 7, 2, "▁"
#: Rounds of expectation, and what every piece counts besides.
ROUNDS, PRIOR = 2, 0.1
#: Longer words are solved one by one; words of a batch; words and bytes counted at once in a worker; rows it gives at once.
LONG, BATCH, COUNTED, COUNTED_BYTES, GIVEN = 48, 20_000, 300_000, 64 << 20, 50_000
LN10 = math.log(10)
#: Not a character: stands for a mark that occurs inside a word, which only bytes can spell.
NONE = 0x110000
_P = 0x9E3779B97F4A7C15


@dataclass
class Unigram:
    """Natural logs of the probabilities of pieces, of bytes, and of the end."""

    pieces: list[str]
    logs: np.ndarray
    bytes: np.ndarray
    end: float

    @functools.cached_property
    def index(self) -> dict[str, int]:
        return {p: k for k, p in enumerate(self.pieces)}

    @functools.cached_property
    def longest(self) -> int:
        return max(map(len, self.pieces))

    @functools.cached_property
    def begins(self) -> set[str]:
        """What longer pieces begin with."""
        return {p[:k] for p in self.pieces for k in range(1, len(p))}

    @functools.cached_property
    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes of the pieces, and which piece each is."""
        h = np.array([prefix_hashes(codes_of([p]))[0, -1] for p in self.pieces], np.uint64)
        order = np.argsort(h)
        return h[order], order


def load(path: str) -> Unigram:
    """The vocabulary of a sentencepiece file with Zipf weights by the rank that its scores give."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, weights = [], []
    for i in range(sp.vocab_size()):
        piece = sp.id_to_piece(i)
        if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)) and MARK not in piece[1:]:
            pieces.append(piece)
            weights.append(1 / (2 - sp.get_score(i)))
    return normalised(pieces, np.array(weights), np.full(256, 1 / (2 + len(pieces))), np.mean(weights))


def normalised(pieces: list[str], weights: np.ndarray, byte_weights: np.ndarray, end: float) -> Unigram:
    total = weights.sum() + byte_weights.sum() + end
    return Unigram(pieces, np.log(weights / total), np.log(byte_weights / total), math.log(end / total))


def codes_of(words: list[str]) -> np.ndarray:
    """Code points of words of one length."""
    return np.array(words).view(np.uint32).reshape(len(words), -1).astype(np.uint64)


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(codes.shape[1]):
            out[:, k + 1] = out[:, k] * np.uint64(_P) + (codes[:, k] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    return out


class Solver:
    """Marginals of words and expected counts of pieces, many words of a length at a time."""

    def __init__(self, model: Unigram, counting: bool = False):
        self.m, self.counting = model, counting
        self.pieces, self.bytes = np.zeros(len(model.pieces)), np.zeros(256)

    def arcs(self, codes: np.ndarray):
        """(from, to, words, pieces) for all pieces that occur at a place."""
        prefix, (known, which) = prefix_hashes(codes), self.m.hashes
        n = codes.shape[1]
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(self.m.longest, _P, np.uint64), dtype=np.uint64)
            for i in range(n):
                for j in range(i + 1, min(n, i + self.m.longest) + 1):
                    h = prefix[:, j] - prefix[:, i] * power[j - i - 1]
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    rows = np.flatnonzero(known[at] == h)
                    if len(rows):
                        yield i, j, rows, which[at[rows]]

    def byte_logs(self, codes: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        kinds, inverse = np.unique(codes, return_inverse=True)
        spelt = [(MARK if c == NONE else chr(c)).encode() for c in kinds.tolist()]
        logs = np.array([self.m.bytes[list(b)].sum() for b in spelt])
        inverse = inverse.reshape(codes.shape)
        return logs[inverse], spelt, inverse

    def same_length(self, words: list[str], weights: np.ndarray | None = None) -> np.ndarray:
        codes = codes_of([MARK + w for w in words])
        codes[:, 1:][codes[:, 1:] == ord(MARK)] = NONE
        n = codes.shape[1]
        arcs = list(self.arcs(codes))
        single, spelt, inverse = self.byte_logs(codes)
        forward = np.full((len(words), n + 1), -np.inf)
        forward[:, 0] = 0
        at = 0
        for i in range(n):
            if i:
                forward[:, i + 1] = np.logaddexp(forward[:, i + 1], forward[:, i] + single[:, i])
            while at < len(arcs) and arcs[at][0] == i:
                _, j, rows, ids = arcs[at]
                forward[rows, j] = np.logaddexp(forward[rows, j], forward[rows, i] + self.m.logs[ids])
                at += 1
        if weights is not None:
            backward = np.full((len(words), n + 1), -np.inf)
            backward[:, n] = 0
            scale = np.log(weights) - forward[:, n]
            at = len(arcs) - 1
            for i in range(n - 1, -1, -1):
                if i:
                    backward[:, i] = backward[:, i + 1] + single[:, i]
                while at >= 0 and arcs[at][0] == i:
                    _, j, rows, ids = arcs[at]
                    backward[rows, i] = np.logaddexp(backward[rows, i], backward[rows, j] + self.m.logs[ids])
                    at -= 1
            for i, j, rows, ids in arcs:
                share = np.exp(forward[rows, i] + self.m.logs[ids] + backward[rows, j] + scale[rows])
                self.pieces += np.bincount(ids, share, len(self.pieces))
            kinds = np.zeros(len(spelt))
            for i in range(1, n):
                share = np.exp(forward[:, i] + single[:, i] + backward[:, i + 1] + scale)
                kinds += np.bincount(inverse[:, i], share, len(spelt))
            for b, share in zip(spelt, kinds, strict=True):
                np.add.at(self.bytes, list(b), share)
        return forward[:, n]

    def one(self, word: str, weight: float | None = None) -> float:
        """The same for one word, of any length: arcs are found again where they are needed, so the memory is two numbers a
        character while pieces are counted, and a few places before the current one otherwise."""
        text = MARK + word.replace(MARK, "\0" if "\0" not in word else "\ufffe")
        n, width = len(text), self.m.longest + 1
        forward = array("d", [-math.inf]) * (n + 1 if weight is not None else min(width, n + 1))
        size = len(forward)
        forward[0] = 0.0
        for i in range(n):
            here = forward[i % size]
            if size <= n:
                forward[i % size] = -math.inf  # this cell is the place's that a piece from the next one may reach
            for j, log, _ in self.ways(text, word, i):
                forward[j % size] = log_add(forward[j % size], here + log)
        whole = forward[n % size]
        if weight is not None:
            backward = array("d", [-math.inf]) * (n + 1)
            backward[n], scale = 0.0, math.log(weight) - whole
            for i in range(n - 1, -1, -1):
                found = self.ways(text, word, i)
                for j, log, _ in found:
                    backward[i] = log_add(backward[i], log + backward[j])
                for j, log, k in found:
                    share = math.exp(min(700.0, forward[i] + log + backward[j] + scale))
                    if k >= 0:
                        self.pieces[k] += share
                    else:
                        for b in word[i - 1].encode():
                            self.bytes[b] += share
        return whole

    def ways(self, text: str, word: str, i: int) -> list[tuple[int, float, int]]:
        """(to, log, piece or -1 for bytes) of the arcs that leave a place of the marked word."""
        find, begins, logs = self.m.index.get, self.m.begins, self.m.logs
        out = []
        for j in range(i + 1, min(len(text), i + self.m.longest) + 1):
            piece = text[i:j]
            k = find(piece)
            if k is not None:
                out.append((j, float(logs[k]), k))
            if piece not in begins:
                break
        if i:
            out.append((i + 1, sum(float(self.m.bytes[b]) for b in word[i - 1].encode()), -1))
        return out

    def words(self, words: list[str], weights: np.ndarray | None = None) -> np.ndarray:
        """Natural logs of the words' marginal probabilities."""
        out = np.empty(len(words))
        length = np.fromiter(map(len, words), int, len(words))
        for n in np.unique(length):
            rows = np.flatnonzero(length == n)
            if n > LONG or len(rows) < 4 or n == 0:
                for r in rows:
                    out[r] = self.one(words[r], None if weights is None else float(weights[r]))
                continue
            for k in range(0, len(rows), BATCH):
                part = rows[k : k + BATCH]
                chosen = [words[r] for r in part]
                if any("\0" in w for w in chosen):  # numpy strings drop trailing zeros
                    for r in part:
                        out[r] = self.one(words[r], None if weights is None else float(weights[r]))
                    continue
                out[part] = self.same_length(chosen, None if weights is None else weights[part])
        return out


def log_add(a: float, b: float) -> float:
    low, high = (a, b) if a < b else (b, a)
    return high if low == -math.inf else high + math.log1p(math.exp(low - high))


def words_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space."""
    return text.encode().lower().split()


def document_log10(model: Unigram, text: str) -> float:
    """log10 of a text's marginal probability, by itself."""
    solver = Solver(model)
    return (sum(solver.one(w.decode()) for w in words_of(text)) + model.end) / LN10


def count_words(docs: DataFrame) -> DataFrame:
    """word, c (in training documents), everywhere."""

    @frugal
    def read(batches):
        learnt, held, size = Counter(), Counter(), 0

        def flush():
            both = [*learnt, *(w for w in held if w not in learnt)]
            return pa.RecordBatch.from_arrays([
                pa.array([w.decode() for w in both], pa.string()), pa.array([learnt[w] for w in both], pa.int64()),
                pa.array([learnt[w] + held[w] for w in both], pa.int64())], names=["word", "c", "everywhere"])

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                text = text.as_py()
                (held if id_crc(doc_id) % FOLDS == HELD else learnt).update(words_of(text))
                size += len(text)
                if len(learnt) + len(held) > COUNTED or size > COUNTED_BYTES:
                    yield flush()
                    learnt.clear(), held.clear()
                    size = 0
        if learnt or held:
            yield flush()

    rows = docs.mapInArrow(read, "word string, c long, everywhere long")
    return rows.groupBy("word").agg(F.sum("c").alias("c"), F.sum("everywhere").alias("everywhere"))


def gathered(batches):
    """Batches put together to about BATCH rows: words of a length are solved at once."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= BATCH:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def expect(counts: DataFrame, model: Unigram, documents: int) -> Unigram:
    """One round: the pieces' expected counts over all training words, with the prior, as the new probabilities."""
    shared = counts.sparkSession.sparkContext.broadcast(model)

    @frugal
    def run(batches):
        solver = Solver(shared.value, True)
        for t in gathered(batches):
            solver.words(t.column("word").to_pylist(), t.column("c").to_numpy().astype(float))
        both = np.concatenate([solver.pieces, solver.bytes])
        ids = np.flatnonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(both[ids])], names=["id", "n"])

    learnt = counts.where("c > 0").select("word", "c").mapInArrow(run, "id int, n double")
    sums = np.zeros(len(model.pieces) + 256)
    for r in learnt.groupBy("id").agg(F.sum("n").alias("n")).collect():  # a row per piece of the vocabulary at most
        sums[r.id] = r.n
    shared.destroy()
    if not sums.any():
        return model
    k = len(model.pieces)
    return normalised(model.pieces, sums[:k] + PRIOR, sums[k:] + PRIOR, documents + PRIOR)


def train(counts: DataFrame, documents: int, path: str, rounds: int = ROUNDS) -> Unigram:
    model = load(path)
    for _ in range(rounds):
        model = expect(counts, model, documents)
    return model


def solve(counts: DataFrame, model: Unigram) -> DataFrame:
    """word, c, everywhere and log10 of the marginal probability."""
    shared = counts.sparkSession.sparkContext.broadcast(model)

    @frugal
    def run(batches):
        for b in gathered(batches):
            logs = Solver(shared.value).words(b.column("word").to_pylist()) / LN10
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(logs, pa.float64())], names=[*b.schema.names, "log10"])

    return counts.mapInArrow(run, "word string, c long, everywhere long, log10 double")


ROWS = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, word string, times long"


def lm_scores(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    A null text is empty: it has the end as its only token. Rows without identifier are learnt from. Repeated rows
    count and are scored each. Without training documents the file's own weights are used. Texts and words of any
    length are read whole, an empty table gives an empty result, and other columns of `docs` are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    counts = checkpointed(count_words(rows))
    n, v, every = counts.agg(F.sum("c"), F.count(F.when(F.col("c") > 0, 1)), F.sum("everywhere")).first()
    ends = rows.where(id_crc_col() % FOLDS != HELD).count()
    n, v = (n or 0) + ends, v + (ends > 0)
    model = train(counts, ends, path)
    solved = checkpointed(solve(counts, model))

    whole = math.log10(n + v + 1)
    least = (every or 0) // BROADCAST_ROWS + 1  # so many words are at least this common: BROADCAST_ROWS at most
    common = {
        r.word.encode(): (math.log10(r.c + 1) - whole, r.log10, r.c > 0)
        for r in solved.where(F.col("everywhere") >= least).select("word", "c", "log10").collect()
    }
    shared = spark.sparkContext.broadcast((common, math.log10(ends + 1) - whole, model.end / LN10))

    @frugal
    def read(batches):
        common, end_base, end = shared.value
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.int64()]
        names = [x.split()[0] for x in ROWS.split(", ")]
        batch = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        out = []
        for b in batches:
            for row, doc_id, text in zip(b.column("row").to_pylist(), b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                words = words_of(text.as_py())
                base, score, known = end_base, end, int(ends > 0)
                for w, k in Counter(words).items():
                    found = common.get(w)
                    if found is None:
                        out.append((row, None, None, None, None, None, None, w.decode(), k))
                        if len(out) >= GIVEN:
                            yield batch(out)
                            out = []
                    else:
                        base += k * found[0]
                        score += k * found[1]
                        known += k * found[2]
                # A word no text has keeps these rows apart in the join.
                out.append((row, doc_id, id_crc(doc_id) % FOLDS == HELD, len(words) + 1, known, base, score, f" {row}", None))
        if out:
            yield batch(out)

    found = rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(read, ROWS)
    rare = solved.where(F.col("everywhere") < least).select("word", "c", "log10")
    joined = found.join(rare.hint("shuffle_hash"), "word", "left")
    times = F.col("times")
    sums = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("n_known", F.when(F.col("c") > 0, times).otherwise(0))).alias("n_known"),
        F.sum(F.coalesce("base_score", times * (F.log10(F.col("c") + 1) - whole))).alias("base_score"),
        F.sum(F.coalesce("score", times * F.col("log10"))).alias("score"),
    )
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
