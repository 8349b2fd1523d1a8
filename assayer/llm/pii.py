"""Personal data by anchors: an automaton finds what such data can't do without, a parser of each kind finds its bounds.

One pass of an Aho-Corasick automaton over a text reports at-signs, schemes, plus signs, digits and identifier cues ("IBAN",
"account", "SSN", ...). From an anchor a parser expands to the left and right by the rules of its kind and validates what it
has found: domains have labels, parts of an address are at most 255, card numbers pass Luhn's check, account numbers their own.
Every parser looks at a stretch of text that no other anchor of its kind shares, so the work is linear in the text.

The base kinds (email, ip, card, phone) are, anchor by anchor, what leftmost matches that don't overlap would be. Further
kinds are added to them: addresses that are written in words, addresses with credentials, and accounts beside a cue.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, frugal, in_parts, kept_for

BASE = ("email", "ip", "card", "phone")
ADDED = ("masked_email", "credentials", "iban", "account", "ssn")
KINDS = BASE + ADDED

#: Cues of each added kind, found in these letters, in small ones, capitals and with a capital first.
CUES = {
    "masked_email": ("(at)", "[at]", "{at}"),
    "iban": ("iban",),
    "account": ("account", "acct", "a/c"),
    "ssn": ("ssn", "social security"),
}
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOT = r"(?:\.|\x20?[\[({]dot[\])}]\x20?)"
MASKED_DOMAIN = re.compile(rf"\x20?[A-Za-z0-9-]+(?:{DOT}[A-Za-z0-9-]+)+", re.I)
AUTHORITY = re.compile(r"[^\s/?#@<>\"']+@[^\s/?#@<>\"']+[^\s<>\"']*")
NAMED = re.compile(r"(?:\x20?(?:number|num|no\.?|nr\.?|code))?\x20?[:#=]?\x20?(?:is\x20)?", re.I)
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
ACCOUNT = re.compile(r"[0-9](?:[\x20-]?[0-9]){5,16}(?![0-9])")
SSN = re.compile(r"(?!000|666|9)[0-9]{3}[\x20-](?!00)[0-9]{2}[\x20-](?!0000)[0-9]{4}(?![0-9])")


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    """Whether the sum of the digits, every second one from the right doubled and its own digits added, is a multiple of 10."""
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(int(d) for d in digits[-1::-2])) % 10 == 0


def iban(text: str) -> bool:
    """The check of ISO 13616: the rest of the number, with letters as 10 to 35 and its beginning last, by 97 is 1."""
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for anchor in ("@", "+", "://", *"0123456789"):
        a.add_word(anchor, ("digit" if anchor.isdigit() else anchor, len(anchor)))
    for kind, cues in CUES.items():
        for cue in cues:
            for spelling in {cue, cue.upper(), cue.title(), cue.capitalize()}:
                a.add_word(spelling, (kind, len(spelling)))
    a.make_automaton()
    return a


def back(text: str, end: int, allowed: frozenset, least: int = 0) -> int:
    """Where the run of allowed characters before `end` begins."""
    while end > least and text[end - 1] in allowed:
        end -= 1
    return end


def spans(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of all finds, in no order; positions are code points."""
    found_to = dict.fromkeys(("email", "ip", "card"), 0)
    for last, (anchor, size) in kept_for("pii", automaton).iter(text):
        at = last + 1 - size
        if anchor == "digit":
            if at >= found_to["card"]:
                m = DIGITS.match(text, at)
                found_to["card"] = m.end()
                digits = digits_of(m.group()) if m.end() - at >= 16 else ""
                if 16 <= len(digits) <= 19 and luhn(digits):
                    yield "card", at, m.end()
            if at >= found_to["ip"]:
                m = DOTTED.match(text, at)
                found_to["ip"] = m.end()
                yield from addresses(m.group(), at)
        elif anchor == "@":
            start = back(text, at, LOCAL, found_to["email"])
            m = DOMAIN.match(text, last + 1) if start < at else None
            if m:
                found_to["email"] = m.end()
                yield "email", start, m.end()
        elif anchor == "+":
            m = PHONE.match(text, at)
            if m and 8 <= len(digits_of(m.group())) <= 15:
                yield "phone", at, m.end()
        else:
            yield from added(text, anchor, at, last + 1)


def addresses(dotted: str, at: int) -> Iterator[tuple[str, int, int]]:
    """Of numbers between dots, each four that follow each other and are at most 255."""
    parts, start = dotted.split("."), at
    for k in range(0, len(parts) - 3, 4):
        four = parts[k : k + 4]
        end = start + sum(map(len, four)) + 3
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
            yield "ip", start, end
        start = end + 1


def added(text: str, kind: str, at: int, end: int) -> Iterator[tuple[str, int, int]]:
    """What a scheme or a cue leads to, if it is valid."""
    if kind == "://":
        start, m = back(text, at, SCHEME), AUTHORITY.match(text, end)
        while start < at and not text[start].isalpha():
            start += 1
        if m and start < at:
            yield "credentials", start, m.end()
    elif kind == "masked_email":
        left = at - 1 if at and text[at - 1] == " " else at
        start, m = back(text, left, LOCAL), MASKED_DOMAIN.match(text, end)
        if m and start < left:
            yield kind, start, m.end()
    else:
        start = NAMED.match(text, end).end()
        m = {"iban": IBAN, "account": ACCOUNT, "ssn": SSN}[kind].match(text, start)
        if m and (kind != "iban" or iban(m.group())):
            yield kind, start, m.end()


def written(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def in_order(text: str) -> list[tuple[str, int, int]]:
    """All finds by kind, then start; a place that two cues lead to counts once."""
    return sorted(set(spans(text)), key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every row; the counts and the digest are of the base kinds.

    Null texts count as empty ones, which have no spans and the digest of nothing. Texts of any length are read whole, rows that
    repeat are reported alike, an empty table gives an empty result, and other columns aren't read, whatever their names.
    """
    bounded_batches(docs.sparkSession)
    names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"]

    @frugal
    def run(batches):
        for b in in_parts(batches):
            found = [in_order(t.as_py() or "") for t in b.column("text")]
            base = [[x for x in f if x[0] in BASE] for f in found]
            counts = [pa.array([sum(x[0] == k for x in f) for f in base], pa.int64()) for k in BASE]
            digests = [hashlib.sha256(written(f).encode()).hexdigest() for f in base]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, pa.array(digests, pa.string()), pa.array(map(written, found), pa.string())], names=names)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str | None) -> str | None:
    """The text with every find replaced by its kind in brackets; of finds that overlap, the text of all goes as the first one."""
    if text is None:
        return None
    parts, at = [], 0
    for kind, start, end in sorted(spans(text), key=lambda x: (x[1], -x[2])):
        if start >= at:
            parts += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def without_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns, with the texts redacted; null texts stay null."""
    bounded_batches(docs.sparkSession)

    @frugal
    def run(batches):
        for b in in_parts(batches):
            at = b.schema.get_field_index(text_col)
            yield b.set_column(at, b.schema.field(at), pa.array([redacted(t.as_py()) for t in b.column(at)], b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
