import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def through(spark, docs, stages):
    for _, stage in stages:
        docs = spark.createDataFrame(stage(spark, docs, "unused").collect(), "doc_id long, text string, lang string, source string, n_chars long")
    return docs


def documents(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "x") for r in given]
    words = given[0]["text"].split(" ")
    near = " ".join([*words[:100], "changed", *words[101:]])
    passage = " ".join(given[5]["text"].split(" ")[:70])
    rows += [(9001, near, "en", "src1", len(near), "x"), (9002, None, None, None, None, None), (9003, "", "en", "a", 0, "x"), (9004, "123 --", "en", "a", 6, "x"),
             (9005, "A lone text of a few words only.", None, None, 32, "x"), (9006, f"Before it. {passage} After that, something of its own follows.", "en", "b", 0, "x")]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_stages_take_effect_and_keep_clean_documents(spark):
    rows, docs = documents(spark)
    one = cp.language_id(spark, docs, "unused")
    assert one.columns == cp.DOCUMENTS
    after = {r["doc_id"]: r for r in one.collect()}
    assert {r[0] for r in rows} - set(after) == {9002, 9003, 9004} and after[9005]["lang"] in {"en", "de", "fr", "es"}
    two = through(spark, docs, cp.STAGES[:2])
    assert two.count() == len(after)
    three = through(spark, docs, cp.STAGES[:3])
    kept = {r["doc_id"] for r in three.collect()}
    assert 9001 not in kept and {rows[0][0], 9005, 9006} <= kept and len(kept) > 45
    four = {r["doc_id"]: r for r in through(spark, docs, cp.STAGES[:4]).collect()}
    assert len(four[9006]["text"]) < 120 and four[9006]["text"].startswith("Before it") and four[9006]["n_chars"] == len(four[9006]["text"])
    pieces = cp.pack(spark, spark.createDataFrame(list(four.values())), "unused").toPandas()
    assert set(pieces["doc_id"]) == set(four) and pieces.groupby("doc_id")["length"].sum().to_dict() == pieces.groupby("doc_id")["doc_tokens"].max().to_dict()


def test_an_empty_table_passes(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, "unused")
        assert docs.columns == cp.DOCUMENTS and docs.count() == 0
    assert cp.pack(spark, docs, "unused").count() == 0


def test_run(spark):
    found = cp.run(spark, "/root/testdata/sf0.001").toPandas()
    assert len(found) and (found.groupby("sequence_id")["length"].sum() <= 2048).all()
