import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenmatch.llm import bpe
from lumenmatch.llm.queries import op6_bpe, vocabulary


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(*vocabulary())


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary()[0], special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab the  \n\t　\xa0'sre1٣_-!\x1c\x85😀"), st.characters(exclude_categories=["Cs"]))))
def test_ids_equal_the_library(codec, library, text):
    ids = codec.encode(text).tolist()
    assert ids == library.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_appends_and_edits_reuse_the_table(codec):
    whole = "unbelievablythoughtful".encode()
    table = codec.prefixes(whole)
    assert codec.prefixes(whole, table[:9]) == table
    assert all(codec.tokens(table[:k]) == codec.tokens(codec.prefixes(whole[:k])) for k in range(1, len(whole) + 1))
    edited = whole[:12] + b"X" + whole[13:]
    assert codec.prefixes(edited, table[:12]) == codec.prefixes(edited)


def test_small_memory_changes_nothing(codec, library, monkeypatch):
    for name in ("SEGMENTS", "PIECES", "TABLES", "PAIRS"):
        monkeypatch.setattr(bpe, name, 700)
    own = bpe.Codec(*vocabulary())
    text = "many different words that make the small memory start anew, again and again " * 3
    assert own.encode(text).tolist() == library.encode_ordinary(text)


def test_hostile_rows(hostile, nothing, library):
    encoded = bpe.encode_texts(hostile, *vocabulary(), keep=("doc_id", "text"))
    assert all(r["ids"] == library.encode_ordinary(r["text"] or "") for r in encoded.collect())
    back = bpe.decode_ids(encoded, *vocabulary(), keep=("doc_id", "text"))
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in back.collect())
    assert bpe.token_digests(nothing, *vocabulary()).count() == 0


def test_query_against_the_library(spark, sf, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op6_bpe(spark, sf).collect():
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
