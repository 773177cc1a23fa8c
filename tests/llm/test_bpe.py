"""The encoder against the tokenizer library, and its prefix tables against fresh ones."""

import random

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskweave.llm import bpe, tokens
from tests.helpers.compare import SMALL

LIBRARY = pytest.importorskip("tokenizers").Tokenizer.from_file(f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.json")
LIBRARY.encode_special_tokens = True
CODEC = bpe.codec()


def expected(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    assert list(CODEC.encode(text)) == expected(text) and CODEC.count(text) == len(expected(text))


@pytest.mark.parametrize("text", ["<|endoftext|>", "a\r\n\r\n  b", "=" * 3000, " " * 5000 + "x", "漢" * 700, "x" * 2500, "I'll're'D", "\x1c \x85 ", "👩‍👩‍👧" * 40])
def test_awkward_texts(text):
    assert list(CODEC.encode(text)) == expected(text)


def test_whole_documents():
    texts = [t for t in pq.read_table(f"{SMALL}/documents.parquet", columns=["text"])["text"].to_pylist() if t]
    assert [list(CODEC.encode(t)) for t in texts] == [expected(t) for t in texts]


def test_edits_and_appends_equal_fresh_tables():
    rng, parts = random.Random(3), [b" ", b"=", b"the", b"ing", "é".encode(), b"0", b"xq", b"    "]
    for _ in range(300):
        data = b"".join(rng.choice(parts) for _ in range(rng.randrange(80)))
        table = bpe.PrefixTable(CODEC, data)
        at, gone, new = rng.randrange(len(data) + 1), rng.randrange(4), rng.choice(parts) * rng.randrange(3)
        table.edit(at, min(gone, len(data) - at), new)
        table.append(b"tail")
        fresh = bpe.PrefixTable(CODEC, data[:at] + new + data[at + min(gone, len(data) - at) :] + b"tail")
        assert (table.last, table.count, table.ids()) == (fresh.last, fresh.count, fresh.ids())


def test_an_edit_near_the_start_leaves_the_rest():
    table = bpe.PrefixTable(CODEC, b"abc" + b"the quick brown fox " * 400)
    assert table.edit(0, 1, b"z") < 1000


def test_reencode():
    old = "== History ==\nThe club won 5 times.\n" * 50
    new = old.replace("5", "599", 1)
    assert CODEC.reencode(old, CODEC.encode(old), new) == CODEC.encode(new)


def test_encode_texts(spark):
    rows = [(1, "hello world", "clash"), (1, "hello world", "clash"), (2, None, None), (3, "", "x"), (None, "a", "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id or 0, tuple(r.ids)) for r in tokens.encode_texts(df).collect())
    assert got == [(0, tuple(expected("a"))), (1, tuple(expected("hello world"))), (1, tuple(expected("hello world"))), (2, ()), (3, ())]
    assert tokens.encode_texts(df.limit(0)).count() == 0
    assert tokens.encode_texts(df).schema["ids"].dataType.simpleString() == "array<int>"
