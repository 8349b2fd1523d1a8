"""Anchors against expressions over the whole text, and what is added to them."""

import hashlib
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from assayer.llm import pii
from tests.llm.conftest import CLASHING, ODD, kept_apart

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        total = sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits))))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if passes(k, m.group())]


def check(text):
    found = pii.in_order(text)
    assert [x for x in found if x[0] in pii.BASE] == base(text)
    assert all(0 <= s < e <= len(text) for _, s, e in found)
    pii.redacted(text)


PIECES = st.sampled_from([
    "@", "a", "b.c", ".", "-", "+", " ", "1", "12", "255", "256", "0001", "4111 1111 1111 1111", "4111111111111111", "+1 (969) 555-1840", "é", "x@y.z",
    "1.2.3.4", "10.20.30.40.50", "(", ")", "://", "https://", "iban", " at ", " dot ", "(at)", "account", "SSN", "%", "İ", "😀", "\n", "9" * 20,
])


@settings(max_examples=1500, deadline=None)
@given(st.lists(PIECES, max_size=14).map("".join))
def test_base_equals_expressions(text):
    check(text)


@settings(max_examples=800, deadline=None)
@given(st.text(alphabet="@+.- ()0123456789aZ%é:/", max_size=60))
def test_base_equals_expressions_on_letters(text):
    check(text)


RUNS = ["a", "1", "1 ", "+1-", "@", "1.", "a@b", "+1 2", "account ", "://", "a(at)b", "iban "]


def test_long_runs():
    for run in RUNS:
        check(run * 300)


def test_long_runs_are_linear():
    """The expressions need the square of these lengths; anchors don't."""
    began = time.perf_counter()
    for run in RUNS:
        text = run * (300_000 // len(run)) + "@"
        assert sorted(pii.spans(text[:-1])) == sorted(pii.in_order(text[:-1])) or run == "a(at)b"
        pii.redacted(text)
    assert time.perf_counter() - began < 30


def test_added_kinds():
    cases = {
        "write to jane.doe (at) example (dot) org now": ("masked_email", "jane.doe (at) example (dot) org"),
        "to jane[at]example.org, please": ("masked_email", "jane[at]example.org"),
        "see https://bob:secret@host.example/path?x=1 there": ("credentials", "https://bob:secret@host.example/path?x=1"),
        "IBAN: GB82 WEST 1234 5698 7654 32.": ("iban", "GB82 WEST 1234 5698 7654 32"),
        "Account number: 12345678 is closed": ("account", "12345678"),
        "SSN 123-45-6789.": ("ssn", "123-45-6789"),
    }
    for text, (kind, want) in cases.items():
        assert [(k, text[s:e]) for k, s, e in pii.in_order(text) if k in pii.ADDED] == [(kind, want)]
        assert want not in pii.redacted(text) and f"[{kind}]" in pii.redacted(text)


def test_nothing_is_added_to_ordinary_text():
    for text in (
        "We met at noon and looked at example pages.", "Look at the dot on the map", "https://example.org/path/12345678", "On account of 12 people", "IBAN GB82 WEST 1234 5698 7654 33",
        "SSN 000-12-3456", "an account of the year 1234", "ssnake 12", "the accounts 2024", "jane at home dot com", "(at) home", "mail (at) home.",
    ):
        assert [x for x in pii.in_order(text) if x[0] in pii.ADDED] == []


def test_report(spark, odd, none, clashing):
    texts = [(i, t) for i, t, _ in ODD] + [(20, "é x@y.de 1.2.3.4, 4111-1111-1111-1111 +1 (969) 555-1840 SSN 123-45-6789")]
    rows = pii.report(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for (i, t), r in zip(texts, rows, strict=True):
        b = base(t or "")
        assert r.doc_id == i and [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x[0] for x in b) for k in PATTERNS]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in b).encode()).hexdigest()
        assert r.spans == ",".join(f"{k}:{s}:{e}" for k, s, e in pii.in_order(t or ""))
    assert rows[-1].spans.endswith("ssn:60:71") and rows[-1].spans.startswith("email:2:8,ip:9:16,card:18:37,phone:38:55")
    assert pii.report(none).count() == 0
    assert sorted(map(str, pii.report(odd).collect())) == sorted(map(str, pii.report(clashing).collect()))


def test_redacted_rows_keep_their_columns(clashing, none):
    out = pii.without_personal_data(clashing)
    rows = out.collect()
    assert out.columns == clashing.columns and len(rows) == len(ODD) and kept_apart(rows) and len(CLASHING) > 9
    assert pii.without_personal_data(none).count() == 0
