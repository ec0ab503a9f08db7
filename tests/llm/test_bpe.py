import hashlib

import public_tokenizers
import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm.bpe import Codec, encode_and_decode
from quire.llm.queries import op9_byte_bpe
from quire.llm.tokens import read_ranks

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return Codec(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


@given(st.lists(st.sampled_from(["a", " ", "  ", "\n", "é", "the", "ing", "12", "'s", "!", "　", "日本", "\t", "ouwh", "𝒳", "<|endoftext|>"]), max_size=20).map("".join))
@settings(max_examples=400, deadline=None)
def test_ids_are_those_of_the_library(codec, library, text):
    ids = codec.encode(text.encode())
    assert ids.tolist() == library.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


@given(st.text(max_size=40))
@settings(max_examples=300, deadline=None)
def test_any_text(codec, library, text):
    assert codec.encode(text.encode("utf-8")).tolist() == library.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 50_000, "ab1" * 20_000, "ing" * 20_000, " " * 5000, "th" * 9999 + "e"])
def test_very_long_matches(codec, library, text):
    assert codec.encode(text.encode()).tolist() == library.encode_ordinary(text)


def test_nulls_repeats_clashes_and_empty_tables(spark, library):
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "the end", "x"), (3, "the end", "x"), (None, "a  b", "x")], "doc_id long, text string, ids string")
    found = encode_and_decode(rows, "doc_id", "text", PATH, public_tokenizers.PATTERN).collect()
    assert sorted((str(r["doc_id"]), r["ids"], bytes(r["decoded"])) for r in found) == sorted((str(i), library.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows.collect())
    assert encode_and_decode(rows.limit(0), "doc_id", "text", PATH, public_tokenizers.PATTERN).count() == 0


def test_the_query_digests(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in op9_byte_bpe(spark, "/root/testdata/sf0.001").collect():
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_mixed_white_space(codec, library):
    rng = np.random.default_rng(5)
    signs = [" ", " ", "\xa0", "\n", "\r", "\t", "\u2003", "\u3000", "\x85", "\x1c", "a", "\u00e9", "\u201c", "b1", "!"]
    for _ in range(5000):
        text = "".join(signs[k] for k in rng.integers(0, len(signs), rng.integers(1, 14)))
        assert codec.encode(text.encode()).tolist() == library.encode_ordinary(text), repr(text)
