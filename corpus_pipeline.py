"""From raw documents to packed training sequences: five stages, each by one operator of ``quire.llm``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import langid, lines, packing, simhash, suffixes
from quire.llm.common import stored
from quire.llm.queries import END_ID, SPECIAL
from quire.llm.registry import reachable, table

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go; where the language is missing, the predicted one is filled in."""
    reachable(spark)
    found = langid.identify(docs.select(*DOCUMENTS), langid.fit(docs))
    return found.where(F.col("lang_pred") != langid.UNKNOWN).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*DOCUMENTS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on a tenth of their source's documents go; all documents stay."""
    reachable(spark)
    kept = lines.drop_boilerplate(docs.select(*DOCUMENTS))
    return kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*DOCUMENTS)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, stays of each group of near duplicates.

    Near duplicates are linked by sets of five-word shingles with a similarity of 0.8 or more, all of them: 512-bit
    fingerprints connect most (candidates share one of 21 segments in one of five orders of the bits), and a prefix
    filter over the sets completes the rest.
    """
    reachable(spark)
    found = simhash.near_duplicates(docs, words=5, bits=512, tau=112, m=21, chain=1, halves=False, rings=5, ring=8, similarity=0.8)
    first = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id")
    return docs.select(*DOCUMENTS).join(first.distinct(), "doc_id", "left_semi")


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that also start in an earlier document go, as whole characters; a document of which
    nothing is left goes as well."""
    reachable(spark)
    found = suffixes.repeated_spans(docs, size=50, characters=True).select("doc_id", F.size("spans").alias("_n"), F.col("kept").cast("string").alias("_kept"))
    # rows that share an id share its smallest (lang, source, n_chars)
    rest = docs.groupBy("doc_id").agg(F.min(F.struct("lang", "source", "n_chars")).alias("_r")).select("doc_id", "_r.*")
    joined = rest.join(found, "doc_id").where((F.col("_n") == 0) | (F.col("_kept") != ""))
    return joined.select("doc_id", F.col("_kept").alias("text"), "lang", "source", F.when(F.col("_n") > 0, F.length("_kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2048 tokens."""
    reachable(spark)
    pieces = packing.tokenise(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), SPECIAL, END_ID, capacity=2048)
    placed = packing.assign(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), capacity=2048)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("simhash_dedup", simhash_dedup), ("suffix_dedup", suffix_dedup), ("packing", pack)]

#: SQL expresses neither the classifier nor the fingerprints, suffixes and tokens; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
