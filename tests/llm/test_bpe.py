import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assayer.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
PATH = bpe.default_path()
LIBRARY = tokenizers.Tokenizer.from_file(PATH)
SMALL = bpe.ByteBpe(PATH, leaf=7, run=5)


def plain(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab e'stlrv  \n\t.!1é漢<|endoftext|>"), max_size=120))
def test_small_leaves_agree(text):
    assert SMALL.encode(text) == plain(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text_agrees(text):
    text = text.encode("utf-8", "ignore").decode()
    assert SMALL.encode(text) == plain(text)
    assert SMALL.decode(plain(text)) == LIBRARY.decode(plain(text), skip_special_tokens=False)


def test_long_runs_agree():
    rng = random.Random(3)
    for letters in ("a", "ab", "the", "aeinost", "0123", "-=", " ", " \n", "é", "漢字"):
        text = "".join(rng.choice(letters) for _ in range(5000))
        assert SMALL.encode(text) == plain(text), letters


def test_decoding_any_ids_agrees():
    rng = random.Random(5)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(rng.randrange(12))]
        assert SMALL.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_common_blocks_split_alike():
    both = bpe.encoder(PATH)
    for start in range(0, 0xD800, 64):
        for c in range(start, start + 64):
            text = f"a{chr(c)}1{chr(c)}! {chr(c)} "
            if bpe.COMMON.search(text) is None:
                assert both.split_common(text) == [text[a:b] for _, (a, b) in both.splitter.pre_tokenize_str(text)]


def test_documents(spark, odd, none):
    got = sorted(map(tuple, bpe.encode_documents(odd, PATH, "digest", leaf=1000).collect()), key=str)
    want = []
    for r in odd.collect():
        ids = plain(r.text or "")
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), text))))
    assert got == sorted(want, key=str)
    assert bpe.encode_documents(none, PATH, "digest").count() == 0
    pairs = bpe.decode_documents(bpe.encode_documents(odd, PATH, leaf=1000), PATH).collect()
    assert sorted(map(str, pairs)) == sorted(str(type(pairs[0])(doc_id=r.doc_id, text=r.text or "")) for r in odd.collect())


def test_oracle_entries_are_sql():
    import __spark_entry__

    sql = __spark_entry__.oracle_sql()
    assert all(isinstance(x, str) for x in sql.values()) and "op5_bpe" not in sql


def test_frequent_words_stay_remembered(monkeypatch):
    """Words that come again and again are encoded once, however many others come between them."""
    monkeypatch.setattr(bpe, "REMEMBERED", 200)
    own = bpe.ByteBpe(PATH)
    asked, model = [], own.plain

    class Counting:
        def encode(self, part, **options):
            asked.append(part)
            return model.encode(part, **options)

    own.plain = Counting()
    for k in range(300):
        text = f" the quick {'x' * (k % 7)}{k}é fox"
        assert own.encode(text) == plain(text)
    assert asked.count(" the") == asked.count(" fox") == 1
    assert len(own.known) + len(own.older) <= 200


def test_digests_of_any_tokens():
    rng = random.Random(6)
    for size in (0, 1, 2, 300):
        ids = [rng.randrange(50257) for _ in range(size)]
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        assert SMALL.digest(bpe.packed(ids)) == (size, *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), text)))
