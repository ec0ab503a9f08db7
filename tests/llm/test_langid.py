import math

import numpy as np

from quire.llm import langid
from quire.llm.queries import op2_language_id


def test_codewords_lie_apart():
    for n in (2, 4, 7, 30):
        code = langid.codewords(n)
        apart = (code.shape[1] - code @ code.T) / 2
        assert (apart[~np.eye(n, dtype=bool)] >= max(1, code.shape[1] // 4)).all()


def test_held_out_accuracy(spark):
    found = op2_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = found[found["held_out"]]
    assert 200 < len(held) < 300 and (held["lang"] == held["lang_pred"]).mean() > 0.98
    assert found["score"].between(0, 1).all()


def test_only_the_text_decides_and_odd_rows_have_results(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs)
    german = "Enbescherverauheit der verachber chheitsch erenstö beßsch, übeen der für teer berheitte und die enzäge"
    rows = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, "123 ... ²", 1.0), (4, german, 1.0), (4, german, 1.0), (5, "x", 1.0), (6, german * 30_000, 1.0), (7, "ö", 1.0)], "doc_id long, text string, score double")
    found = langid.identify(rows, model)
    assert found.columns == ["doc_id", "text", "lang_pred", "score", "ambiguous"]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in found.select("doc_id", "lang_pred", "score").collect()}
    assert [got[k][0] for k in (1, 2, 3)] == ["und"] * 3 and got[1][1] == 0.0
    assert got[4][0] == got[6][0] == "de" and {got[5][0], got[7][0]} <= set(model.languages)
    assert langid.identify(rows.limit(0), model).count() == 0


def test_nothing_or_one_language_learned(spark):
    rows = spark.createDataFrame([(1, "abc", None), (2, None, "en"), (None, "abc", "en")], "doc_id long, text string, lang string")
    none = langid.fit(rows)
    assert none.languages == [] and {r["lang_pred"] for r in langid.identify(rows, none).collect()} == {"und"}
    one = langid.fit(spark.createDataFrame([(1, "abc", "en")], "doc_id long, text string, lang string"))
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(rows, one).collect()}[1] == ("en", 1.0)


def test_the_model_is_the_same_each_time(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert np.array_equal(langid.fit(docs).weights, langid.fit(docs.repartition(5)).weights)


def scored(model, text):
    """Language and score of one text, gram by gram and bit by bit."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    folded = [b | 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in text.encode()]
    sums, used = [0.0] * model.code.shape[1], 0
    for x, y, z in zip(folded, folded[1:], folded[2:]):
        if y == 32 and 32 in (x, z):
            continue
        place = (x << 16 | y << 8 | z) * 2654435761 % 2**32 >> 18
        used += 1
        for bit in range(len(sums)):
            sums[bit] += float(model.weights[place, bit])
    outputs = [s / max(used, 1) + float(b) for s, b in zip(sums, model.bias)]
    losses = [sum(float(t) * math.log1p(math.exp(-4 * min(8, max(-8, o * c)))) for o, c, t in zip(outputs, word, model.trust)) for word in model.code]
    near = [math.exp(-4 * (loss - min(losses))) for loss in losses]
    best = max(range(len(near)), key=lambda k: near[k])
    return model.languages[best], near[best] / sum(near)


def test_whole_texts_score_as_by_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs)
    texts = [r["text"] for r in docs.limit(60).collect()] + [None, "", "12 ..", "a", "ab", "Été!", "  x  y ", "ß" * 50, "MIXED und the le\nque"]
    found = langid.identify(spark.createDataFrame(list(enumerate(texts)), "k long, text string"), model).collect()
    for r in found:
        lang, score = scored(model, texts[r["k"]])
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-4, texts[r["k"]]
