"""Byte-level BPE encoding and decoding, with long texts encoded as a tree of halves.

A text is cut at added tokens, then into pre-tokens by the pattern, and each pre-token into tokens by merges. A
text of more than LEAF characters is cut into leaves that are encoded in parallel as rows of their own; then
fragments are joined two by two. A join re-encodes a window around the cut and lets it grow until it agrees with
the left fragment at its start and with the right one at its end:

- Pre-tokens. The pattern looks ahead by one character and its longest fixed alternative has three, so in a text
  that goes on only the last two pre-tokens can change. Scanning restarts one before those. As soon as the scan
  reaches a boundary of the right fragment, everything after it is the same, as the pattern never looks back.
- Tokens. A pre-token that spans the cut is joined from the tokens of its two parts. A sequence of tokens is the
  encoding of its text exactly if every two neighbours are, so a window whose first and last tokens are those
  that both sides had can be put in their place.

The same join serves inside one task for unsplit runs of more than RUN bytes.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, frugal, frugal_group, in_parts, kept_for, text_of

#: Characters of a leaf of the tree, and bytes of a run that is encoded at once.
LEAF, RUN = 32_768, 2_048
#: Pre-tokens remembered by a worker, in two halves, and the most characters of one.
REMEMBERED, LONGEST = 340_000, 64

#: Fixed value: the pattern of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: In these blocks the regex module's classes and the library's agree; other texts are split by the library itself.
COMMON = re.compile("[^\u0000-ԯḀ-⁯₠-₿　-鿿가-힣]")


def packed(ids: list[int]) -> bytes:
    """Tokens as they are remembered: as bytes they take less memory than a tuple of numbers."""
    return array("i", ids).tobytes()


def numbers(tokens: bytes) -> list[int]:
    return memoryview(tokens).cast("i").tolist()


def together(parts: pa.Array) -> bytes:
    """The bytes of an array's values, one after another; none of them is null."""
    if not len(parts):
        return b""
    _, bounds, data = parts.buffers()
    first, last = np.frombuffer(bounds, np.int32)[[parts.offset, parts.offset + len(parts)]].tolist()
    return data.slice(first, last - first).to_pybytes()


def characters(found: list[str]) -> str:
    """What stands in a class of a pattern for these characters, which are in order."""
    codes = list(map(ord, found))
    starts = [c for k, c in enumerate(codes) if not k or codes[k - 1] != c - 1]
    ends = [c for k, c in enumerate(codes) if k + 1 == len(codes) or codes[k + 1] != c + 1]
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(starts, ends, strict=True))


def common_pattern() -> str:
    """PATTERN for texts of common blocks only, without classes that the re module, which is faster than regex, doesn't have."""
    import regex

    common = [c for c in map(chr, range(0x10000)) if COMMON.search(c) is None]
    letter, digit, space = (characters(list(filter(regex.compile(c).match, common))) for c in (r"\p{L}", r"\p{N}", r"\s"))
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{digit}]+| ?[^{space}{letter}{digit}]+|[{space}]+(?![^{space}])|[{space}]+"


class Known(dict):
    """Tokens by pre-token; those that aren't there are asked for."""

    def __init__(self, learn: Callable[[str], bytes]):
        super().__init__()
        self.learn = learn

    def __missing__(self, part: str) -> bytes:
        return self.learn(part)


@dataclass
class Fragment:
    """A stretch of text with its pre-tokens and, for each of them, its tokens, packed."""

    parts: list[str]
    tokens: list[bytes]


class ByteBpe:
    """The encoder of a tokenizer file; results equal those of the tokenizers library."""

    def __init__(self, path: str, leaf: int = LEAF, run: int = RUN):
        from tokenizers import Tokenizer, pre_tokenizers

        self.leaf, self.run = leaf, run
        self.library = Tokenizer.from_file(path)
        self.splitter = self.library.pre_tokenizer
        self.split_common = re.compile(common_pattern()).findall
        self.plain = Tokenizer(self.library.model)  # the same model, not another copy
        self.plain.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bare = Tokenizer(self.library.model)
        self.names = {i: t for t, i in self.library.get_vocab(with_added_tokens=True).items()}
        added = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = {t: self.library.token_to_id(t) for t in added}
        self.cut_added = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        back = {c: b for b, c in self.letters.items()}
        self.bytes_of = {
            i: bytes(back[c] for c in name) if all(c in back for c in name) else name.encode()
            for i, name in self.names.items()
        }
        self.known, self.older = Known(self.learn), {}  # when the first is half of what may be remembered, it becomes the second
        every = range(max(self.names) + 1)
        self.decimals = pa.array([f"{i}," for i in every], pa.binary())
        self.raw = pa.array([self.bytes_of.get(i, b"") for i in every], pa.binary())

    def split(self, text: str) -> list[str]:
        if COMMON.search(text) is None:
            return self.split_common(text)
        return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]

    # Tokens of one pre-token.

    def part(self, part: str) -> bytes:
        return self.known[part]

    def learn(self, part: str) -> bytes:
        found = self.older.pop(part, None)
        if found is None:
            raw = part.encode()
            if len(raw) > self.run:
                return packed(self.run_tokens("".join(self.letters[b] for b in raw)))
            found = packed(self.plain.encode(part, add_special_tokens=False).ids)
        if len(part) <= LONGEST:
            if len(self.known) >= REMEMBERED // 2:
                self.known, self.older = Known(self.learn), self.known
            self.known[part] = found
        return found

    def run_tokens(self, letters: str) -> list[int]:
        """A long run by halves."""
        if len(letters) <= self.run:
            return self.bare.encode(letters, add_special_tokens=False).ids
        middle = len(letters) // 2
        return self.join_tokens(self.run_tokens(letters[:middle]), self.run_tokens(letters[middle:]))

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        width = 4
        while True:
            tail, head = left[-width:], right[:width]
            window = self.bare.encode("".join(self.names[i] for i in [*tail, *head]), add_special_tokens=False).ids
            if (len(tail) == len(left) or window[0] == tail[0]) and (len(head) == len(right) or window[-1] == head[-1]):
                return left[: len(left) - len(tail)] + window + right[len(head) :]
            width *= 2

    # Stretches of text without added tokens.

    def fragment(self, text: str) -> Fragment:
        parts = self.split(text)
        return Fragment(parts, [self.part(p) for p in parts])

    def join(self, left: Fragment, right: Fragment) -> Fragment:
        if not left.parts or not right.parts:
            return left if left.parts else right
        back, ahead = 3, 4
        while True:
            keep = max(0, len(left.parts) - back)
            tail, head = left.parts[keep:], right.parts[:ahead]
            cut, whole = sum(map(len, tail)), ahead >= len(right.parts)
            scanned = self.split("".join(tail) + "".join(head))
            ends, at = {cut: 0}, cut
            for k, part in enumerate(head):
                ends[at := at + len(part)] = k + 1
            at, met = 0, None
            for k, part in enumerate(scanned if whole else scanned[:-2]):
                at += len(part)
                if at >= cut and at in ends:
                    met = (k + 1, ends[at])
                    break
            if met and (not keep or scanned[0] == tail[0]):
                break
            back, ahead = (back * 2, ahead) if met else (back, ahead * 2)
        window = scanned[: met[0]]
        tokens = [self.part(p) for p in window] if len(window) > 1 or len(window[0]) <= self.run else []
        if not tokens:
            tokens = [self.spanning(window[0], left, right)]
        return Fragment(
            left.parts[:keep] + window + right.parts[met[1] :], left.tokens[:keep] + tokens + right.tokens[met[1] :]
        )

    def spanning(self, part: str, left: Fragment, right: Fragment) -> bytes:
        """Tokens of a long pre-token that is the last one of the left and the first one of the right put together."""
        if part == left.parts[-1] + right.parts[0]:
            return packed(self.join_tokens(numbers(left.tokens[-1]), numbers(right.tokens[0])))
        return self.part(part)

    def tree(self, fragments: list[Fragment]) -> Fragment:
        while len(fragments) > 1:
            pairs = zip(fragments[::2], fragments[1::2], strict=False)
            fragments = [self.join(a, b) for a, b in pairs] + (fragments[-1:] if len(fragments) % 2 else [])
        return fragments[0]

    def leaves(self, text: str) -> list[str]:
        """Pieces of equal length, as halving until none is longer than a leaf gives."""
        count = 1
        while len(text) > self.leaf * count:
            count *= 2
        bounds = [len(text) * k // count for k in range(count + 1)]
        return [text[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    # Whole texts.

    def stretches(self, text: str) -> list[str]:
        """Stretches of text and added tokens in turn."""
        return self.cut_added.split(text) if self.cut_added and "<" in text else [text]

    def tokens(self, text: str) -> bytes:
        out: list[bytes] = []
        for k, stretch in enumerate(self.stretches(text)):
            if k % 2:
                out.append(packed([self.added[stretch]]))
            elif len(stretch) > self.leaf:
                out += self.tree([self.fragment(x) for x in self.leaves(stretch)]).tokens
            elif stretch:
                out += map(self.known.__getitem__, self.split(stretch))
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return numbers(self.tokens(text))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def digest(self, tokens: bytes) -> tuple[int, str, str]:
        ids = pa.array(np.frombuffer(tokens, np.int32))
        decoded = together(self.raw.take(ids)).decode("utf-8", "replace")
        listed = together(self.decimals.take(ids))[:-1]
        return len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def encoder(path: str, leaf: int = LEAF) -> ByteBpe:
    return kept_for(("bpe", path, leaf), lambda: ByteBpe(path, leaf))


IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
DDL = {"ids": "doc_id long, ids array<int>", "digest": "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"}


def rows_of(bpe: ByteBpe, found: Iterator[tuple[int | None, bytes]], emit: str) -> pa.RecordBatch:
    if emit == "ids":
        ids, lists = zip(*((i, np.frombuffer(x, np.int32)) for i, x in found), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lists, pa.list_(pa.int32()))], schema=IDS)
    columns = zip(*[(i, *bpe.digest(x)) for i, x in found], strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, DIGESTS, strict=True)], schema=DIGESTS)


def encode_documents(docs: DataFrame, path: str, emit: str = "ids", leaf: int = LEAF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the token ids of every row's whole text, or with emit="digest" their number and digests.

    A null text counts as empty, and an empty one has no tokens. Repeated rows give repeated results; other
    columns are not read. Rows of more than `leaf` characters are cut into leaves that any executor encodes.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    long = F.length("text") > leaf

    @frugal
    def whole(batches):
        bpe = encoder(path, leaf)
        for b in in_parts(batches):
            texts = (x.as_py() for x in b.column("text"))
            yield rows_of(bpe, ((i, bpe.tokens(t)) for i, t in zip(b.column("doc_id").to_pylist(), texts, strict=True)), emit)

    def cut(batches):
        bpe = encoder(path, leaf)
        names = ["row", "doc_id", "ord", "added", "text"]
        for b in batches:
            for row, doc_id, text in zip(*(b.column(c) for c in ("row", "doc_id", "text")), strict=True):
                leaves = []
                for k, stretch in enumerate(bpe.stretches(text.as_py())):
                    leaves += [(k % 2 == 1, k, x) for x in ([stretch] if k % 2 else bpe.leaves(stretch))]
                yield pa.RecordBatch.from_arrays([
                    pa.array([row.as_py()] * len(leaves)), pa.array([doc_id.as_py()] * len(leaves), pa.int64()),
                    pa.array(range(len(leaves)), pa.int32()),
                    pa.array([k for _, k, _ in leaves], pa.int32()), pa.array([x for *_, x in leaves])], names=names)

    @frugal
    def encode_leaves(batches):
        bpe = encoder(path, leaf)
        for b in in_parts(batches, 64):
            lengths, counts, ids = [], [], []
            for k, text in zip(b.column("added").to_pylist(), b.column("text").to_pylist(), strict=True):
                f = Fragment([text], [packed([bpe.added[text]])]) if k % 2 else bpe.fragment(text)
                lengths.append(packed([len(p) for p in f.parts]))
                counts.append(packed([len(t) for t in f.tokens]))
                ids.append(b"".join(f.tokens))
            whole = [pa.array(x, pa.binary()) for x in (lengths, counts, ids)]
            yield pa.RecordBatch.from_arrays([*b.columns, *whole], names=[*b.schema.names, "lengths", "counts", "ids"])

    @frugal_group
    def joined(table: pa.Table) -> pa.Table:
        bpe = encoder(path, leaf)
        table = table.sort_by("ord")
        stretches: dict[int, list[Fragment]] = {}
        for k, text, lengths, counts, ids in zip(*(table.column(c) for c in ("added", "text", "lengths", "counts", "ids")), strict=True):
            text, ids, parts, tokens, a, t = text.as_py(), ids.as_py(), [], [], 0, 0
            for n, c in zip(numbers(lengths.as_py()), numbers(counts.as_py()), strict=True):
                parts.append(text[a : a + n])
                tokens.append(ids[t : t + c])
                a, t = a + n, t + c
            stretches.setdefault(k.as_py(), []).append(Fragment(parts, tokens))
        ids = b"".join(t for k in sorted(stretches) for t in bpe.tree(stretches[k]).tokens)
        return pa.Table.from_batches([rows_of(bpe, iter([(table.column("doc_id")[0].as_py(), ids)]), emit)])

    short = rows.where(~long).select("doc_id", "text").mapInArrow(whole, DDL[emit])
    leaf_ddl = "row long, doc_id long, ord int, added int, text string"
    pieces = rows.where(long).mapInArrow(cut, leaf_ddl).repartition("row", "ord")
    coded = pieces.mapInArrow(encode_leaves, leaf_ddl + ", lengths binary, counts binary, ids binary")
    return short.unionByName(coded.groupBy("row").applyInArrow(joined, DDL[emit]))


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); special tokens are kept, and null ids give an empty text."""

    def decode(batches):
        bpe = encoder(path)
        for b in in_parts(batches):
            texts = [bpe.decode(x.as_py() or []) for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
