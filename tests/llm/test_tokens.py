"""Problem 7: the same ids as the library that reads the same vocabulary, and exact round trips."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import tokens

tiktoken = pytest.importorskip("tiktoken")
vocabularies = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=vocabularies.PATTERN, mergeable_ranks=tokens.encoder().ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=80))
def test_any_text(library, text):
    ids = tokens.encoder().encode(text)
    assert ids == library.encode_ordinary(text) and tokens.encoder().decode(ids) == text


def test_long_pieces(library):
    for text in ("a" * 30_000, "ab" * 20_000, "漢" * 5_000, "0123456789" * 3_000, " " * 9_999, "\n" * 5_000):
        assert tokens.encoder().encode(text) == library.encode_ordinary(text)


def test_other_vocabulary(library):
    text = "Привет, 世界! ปั๊ม"
    assert tokens.encoder("byte_bpe_multi_50k.tiktoken").decode(tokens.encoder("byte_bpe_multi_50k.tiktoken").encode(text)) == text


def test_rows(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "Seal <|endoftext|> 油"), (3, "Seal <|endoftext|> 油"), (None, "x")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    out = tokens.ids(rows)
    got = {r["doc_id"]: r["ids"] for r in out.collect()}
    assert out.columns == ["doc_id", "ids"] and out.count() == 5 and got[1] == [] and got[2] == [] and max(got[3]) < 50256
    assert {r["doc_id"]: r["text"] for r in tokens.texts(out).collect()}[3] == "Seal <|endoftext|> 油"
    assert tokens.ids(rows.limit(0)).count() == 0
