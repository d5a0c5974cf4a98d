import random
import time

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scanloom.llm import queries_text as Q
from scanloom.llm.tokenize import VOCABULARY, Encoder, Vocabulary, decode, encode

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(Vocabulary.read())


def ids_of(encoder, texts):
    offsets, ids = encoder.encode(texts)
    return [list(ids[a:b]) for a, b in zip(offsets, offsets[1:])]


def test_whole_table_equals_library(spark, folder, library):
    texts = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{folder}/documents.parquet").to_pylist()}
    expected = dict(zip(texts, library(list(texts.values()))))
    got = Q.p8_ids(spark, folder).collect()
    assert len(got) == len(texts) and all(list(r.ids) == expected[r.doc_id] for r in got)


def test_special_cases(spark):
    texts = [None, "", " ", "<|endoftext|>", "a\x0c\n b", "x " * 30_000, "=" * 50_000, "日本語" * 500, "don't stop\r\n\r\n  now", "\x1c \x1c", "𝕏🙂"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").selectExpr("doc_id", "text", "1 AS ids")
    got = {r.doc_id: list(r.ids) for r in encode(df, "doc_id", "text", tokens_at_once=1000).collect()}
    t = tokenizers.Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    back = {r.doc_id: r.text for r in decode(encode(df, "doc_id", "text"), "doc_id", "ids").collect()}
    assert back == {i: x or "" for i, x in enumerate(texts)}
    assert encode(df.limit(0), "doc_id", "text").count() == 0


def test_decode_cases(spark):
    df = spark.createDataFrame([(1, [64, 65]), (2, None), (3, [10_000_000]), (4, [])], "k int, ids array<int>")
    assert {r.k: r.text for r in decode(df, "k", "ids").collect()} == {1: "ab", 2: None, 3: None, 4: ""}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=40), max_size=5))
def test_any_text_equals_library(encoder, library, texts):
    assert ids_of(encoder, texts) == library(texts)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=" \n\t\r\x0c\x1c  ab1'.s", max_size=60))
def test_white_space_equals_library(encoder, library, text):
    assert ids_of(encoder, [text]) == library([text])


def test_long_words(encoder, library):
    draw = random.Random(5)
    blobs = ["".join(draw.choice("abcdefghij") for _ in range(n)) for n in (900, 1001, 1500)] + ["a" * 1300, "é" * 700, "".join(draw.choice("etaoinshrdlu") for _ in range(40_000))]
    expected = library(blobs)
    assert ids_of(encoder, blobs) == expected
    began = time.time()
    assert list(encoder._contracted(blobs[-1].encode())) == expected[-1]
    assert time.time() - began < 5
    assert [list(encoder._contracted(b.encode())) for b in blobs] == expected
