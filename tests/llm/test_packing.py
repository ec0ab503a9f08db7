import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quire.llm import packing
from quire.llm.queries import END_ID, SPECIAL, op1_packing

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_knapsack_takes_the_best_multiset():
    value, pattern = packing.knapsack(np.array([3.0, 5.0, 8.5]), np.array([2, 3, 5]), 10)
    assert value == 17.0 and pattern @ np.array([2, 3, 5]) <= 10 and pattern @ np.array([3.0, 5.0, 8.5]) == 17.0


def test_column_generation_meets_the_demand_near_the_bound():
    rng = np.random.default_rng(2)
    sizes, demand = np.arange(1, 33), rng.integers(0, 300, 32)
    plan = packing.cutting_stock(sizes, demand, 32)
    assert all(p @ sizes <= 32 for p, _ in plan)
    assert (sum(p * t for p, t in plan) >= demand).all()
    assert sum(t for _, t in plan) <= 1.03 * sizes @ demand / 32 + 20
    assert packing.cutting_stock(np.zeros(0, int), np.zeros(0, int), 32) == []


def rows_of(spark):
    words = "the of and ingthtion ouwhea"
    texts = {1: None, 2: "", 3: "a", 4: "two  spaces\n\n and <|endoftext|> inside<|endoftext|>", 5: words * 3000, 6: "é 日本  x", 7: words, 8: words}
    return texts, spark.createDataFrame([(i, t, "x", i, "y") for i, t in texts.items()], "doc_id long, text string, ids string, sequence_id long, length string")


def test_pieces_hold_every_id_once(spark):
    texts, rows = rows_of(spark)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = packing.tokenise(rows, RANKS, SPECIAL, END_ID, capacity=64)
    placed = packing.assign(pieces, capacity=64)
    found = placed.collect()
    for id, text in texts.items():
        expected = [*tokenizer.encode(text or "", add_special_tokens=False).ids, END_ID]
        own = sorted((r for r in found if r["doc_id"] == id), key=lambda r: r["start"])
        got = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in own]).tolist()
        assert got == expected and {r["doc_tokens"] for r in own} == {len(expected)}
        assert [r["start"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist()
    by = {}
    for r in found:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts)])[:-1].tolist() and sum(n for _, n in parts) <= 64
    whole = packing.sequences(placed, 64, pad_id=9).collect()
    assert len(whole) == len(by) and all(len(r["ids"]) == 256 for r in whole)
    r = whole[0]
    assert r["n_tokens"] == 64 or set(np.frombuffer(r["ids"], "<u4")[r["n_tokens"] :]) == {9}


def test_an_empty_table_packs_to_nothing(spark):
    pieces = packing.tokenise(spark.createDataFrame([], "doc_id long, text string"), RANKS, SPECIAL, END_ID)
    assert packing.assign(pieces).collect() == []


def test_the_query_wastes_little(spark):
    found = op1_packing(spark, "/root/testdata/sf0.001").toPandas()
    tokens, sequences = found["length"].sum(), found["sequence_id"].nunique()
    assert tokens / (2048 * sequences) > 0.93
    one = found.iloc[0]
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(f"doc_id = {one['doc_id']}").first()["text"]
    ids = [*Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids, 1]
    part = np.array(ids[one["start"] : one["start"] + one["length"]], "<u4")
    assert zlib.crc32(part.tobytes()) == one["ids_crc32"] and len(ids) == one["doc_tokens"]


def test_mixed_white_space_gets_the_ids_of_the_tokenizer(spark):
    rng = np.random.default_rng(4)
    signs = [" ", " ", "\xa0", "\n", "\t", "\u2003", "\u3000", "\x85", "\x1c", "a", "\u00e9", "\u201c", "b1", "!"]
    texts = [" \xa0 \xa0", "\xa0 ", " \n", "a \n b", "x\xa0 y"] + ["".join(signs[k] for k in rng.integers(0, len(signs), rng.integers(1, 14))) for _ in range(3000)]
    found = packing.tokenise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), RANKS, SPECIAL, END_ID).collect()
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert len(found) == len(texts)
    for r in found:
        assert np.frombuffer(r["ids"], "<u4").tolist() == [*reference.encode(texts[r["doc_id"]], add_special_tokens=False).ids, END_ID], repr(texts[r["doc_id"]])
