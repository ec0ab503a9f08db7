"""Nested JSON manifests as adjacency rows.

Two layouts: ``files`` (one manifest per file, the packet is the file path) and ``lines`` (one
``{"packet_id": ..., "manifest": {...}}`` object per line), which is splittable and the form
to use for millions of packets.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.limits import MAX_MANIFEST_BYTES, MAX_NESTING
from quire.operators.scan import durable
from quire.sources import manifest_rules as rules

#: A surrogate escape without its other half.
LONE_SURROGATE = (
    r"(?<!\\)(?:\\\\)*(?:\\u[dD][89abAB][0-9a-fA-F]{2}(?!\\u[dD][c-fC-F][0-9a-fA-F]{2})"
    r"|(?<!\\u[dD][89abAB][0-9a-fA-F]{2})\\u[dD][c-fC-F][0-9a-fA-F]{2})"
)


class Manifests(NamedTuple):
    packets: DataFrame
    items: DataFrame
    rejects: DataFrame


def _get(path: str, kind: str, column: str = "node") -> Column:
    return F.try_variant_get(F.col(column), f"$.{path}", kind)


def _member(name: str) -> Column:
    return F.try_variant_get(F.col("node"), f"$['{name}']", "variant")


@contextmanager
def _as_written(spark: SparkSession) -> Iterator[None]:
    """Stored variants keep the kinds of their numbers: columns inferred from them would turn integers beside reals into reals."""
    name = "spark.sql.variant.inferShreddingSchema"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def parse_manifests(texts: DataFrame) -> Manifests:
    """``texts``: packet_id, manifest (JSON text).  Rejected packets keep no items.

    Each text is parsed once, between brackets and before a second element, so that data after the object is a fault of
    syntax. A text that only a lenient reader takes repeats a member. ``rejects`` has one row per refused packet: the
    first fault of the root's members in their order, else that of the first faulty item in document order; inside
    nested objects members are judged in a fixed order, as their own is not kept. Null texts are faults of syntax; repeated texts and ids are
    packets of their own only as far as their ids differ.
    """
    spark = texts.sparkSession
    body = F.regexp_replace("manifest", "^\ufeff", "")
    read = texts.select("packet_id", F.octet_length("manifest").alias("_bytes"), body.alias("_body")).withColumn(
        "_both", F.try_parse_json(F.concat(F.lit("["), "_body", F.lit("\n,0]"))))
    parsed = read.select(
        "packet_id", "_bytes", "_body", F.try_variant_get("_both", "$[0]", "variant").alias("node"), F.size(F.try_variant_get("_both", "$", "array<variant>")).alias("_parts"),
        F.json_object_keys("_body").alias("_written"))
    lenient = F.from_json("_body", "map<string,string>", {"allowSingleQuotes": "false"})
    twice = F.col("_parts").isNull() & F.col("_written").isNotNull() & lenient.isNotNull() & F.try_parse_json("_body").isNull()
    sound = (F.col("_parts") == 2) & ~F.col("_body").rlike(LONE_SURROGATE)
    fault = (
        F.when(F.col("_bytes") > MAX_MANIFEST_BYTES, "plan_too_large")
        .when(twice, "plan_duplicate_member")
        .when(~F.coalesce(sound, F.lit(False)), "plan_syntax")
        .otherwise(rules.root_fault(F.col("node"), F.coalesce("_written", F.array().cast("array<string>"))))
    )
    with _as_written(spark):
        roots = durable(parsed.select("packet_id", "node", fault.alias("code")))
        refused = roots.filter("code is not null").select("packet_id", F.lit("").alias("ref"), "code")
        level = roots.filter("code is null").select(
            "packet_id", F.lit(None).cast("string").alias("parent_ref"), F.lit("").alias("ref"), F.array().cast("array<bigint>").alias("ref_path"), "node"
        )
        levels = []
        for _ in range(MAX_NESTING + 2):
            children = level.drop("pos").withColumn("_items", _member("items")).filter(F.col("_items").isNotNull())
            exploded = children.lateralJoin(spark.tvf.variant_explode(F.col("_items").outer()))
            level = durable(exploded.filter("pos is not null").select(
                "packet_id", F.col("ref").alias("parent_ref"), F.concat("ref", F.lit("/items/"), F.col("pos").cast("string")).alias("ref"),
                F.concat("ref_path", F.array(F.col("pos").cast("bigint"))).alias("ref_path"), F.col("pos").cast("bigint").alias("pos"),
                F.col("value").alias("node"),
            ))
            levels.append(level)
            if level.isEmpty():
                break
    rows = levels[0]
    for deeper in levels[1:]:
        rows = rows.unionByName(deeper)
    too_deep = F.size("ref_path") > MAX_NESTING + 1
    judged = durable(rows.select("packet_id", "ref", "ref_path", _member("contents").isNotNull().alias("contents"),
                                 F.when(too_deep, "plan_limit").otherwise(rules.item_fault(F.col("node"))).alias("code")))
    # a packet has at most one table of contents; the later ones are its faults
    first = Window.partitionBy("packet_id").orderBy("ref_path")
    again = judged.filter("contents and code is null").withColumn("_n", F.row_number().over(first)).filter("_n > 1")
    faults = judged.filter("code is not null").select("packet_id", "ref_path", "ref", "code")
    faults = faults.unionByName(again.select("packet_id", "ref_path", "ref", F.lit("plan_value").alias("code")))
    earliest = faults.groupBy("packet_id").agg(F.min_by(F.struct("ref", "code"), "ref_path").alias("_f"))
    rejects = refused.unionByName(earliest.select("packet_id", "_f.ref", "_f.code"))
    bad = rejects.select("packet_id").distinct()
    packets = roots.filter("code is null").select(
        "packet_id", _get("output", "string").alias("output"), _get("dir", "string").alias("dir"),
        _get("timestamp", "bigint").alias("timestamp"), F.coalesce(_get("structure", "string"), F.lit("preserve")).alias("structure"),
        *[_get(f"metadata.{n}", "string").alias(n) for n in ("title", "author", "subject", "language")],
        _get("fitting.target", "string").alias("fit_target"), _get("fitting.tolerance", "string").alias("fit_tolerance"),
        _get("page_numbers.mode", "string").alias("number_mode"), _get("page_numbers.start", "bigint").alias("number_start"),
        _get("page_numbers.kinds", "array<string>").alias("number_kinds"), _get("page_numbers.position", "string").alias("number_position"),
        _get("page_defaults.size", "string").alias("default_size"),
    )
    pairs = _get("pages", "array<array<bigint>>")
    items = rows.select(
        "packet_id", "ref", "parent_ref", "ref_path", "pos",
        F.when(_member("source").isNotNull(), "source").when(_member("page").isNotNull(), "page")
        .when(_member("contents").isNotNull(), "contents").when(_member("items").isNotNull(), "group").alias("kind"),
        _get("source", "string").alias("path"),
        F.transform(pairs, lambda p: F.struct(F.get(p, 0).alias("first"), F.get(p, 1).alias("last"))).alias("ranges"),
        F.when(_member("page").isNotNull(), F.coalesce(_get("count", "bigint"), F.lit(1))).alias("count"),
        F.coalesce(_get("title", "string"), _get("contents.title", "string")).alias("title"),
        _get("start_on", "string").alias("start_on"), _get("dir", "string").alias("dir"), _get("numbering", "boolean").alias("numbering"),
        _member("divider").isNotNull().alias("divider"), _get("divider.text.value", "string").alias("divider_text"),
        _get("page.text.value", "string").alias("text"),
        F.coalesce(_get("page.size", "string"), _get("contents.size", "string"), _get("divider.size", "string")).alias("size"),
    )
    return Manifests(
        packets.join(bad, "packet_id", "left_anti"), items.join(bad, "packet_id", "left_anti"), rejects
    )


def scan_manifests(spark: SparkSession, path: str, layout: str = "files") -> Manifests:
    """Read manifests and unnest them level by level."""
    if layout == "files":
        texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("packet_id"), F.col("value").alias("manifest"))
    elif layout == "lines":
        # the manifest's own text, with repeated members and spellings of numbers as written
        envelope = F.from_json("value", "packet_id string, manifest string", {"allowSingleQuotes": "false"})
        lines = spark.read.text(path).select("value", envelope.alias("_e"))
        texts = lines.select(
            F.coalesce("_e.packet_id", F.sha2(F.col("value").cast("binary"), 256)).alias("packet_id"),
            F.col("_e.manifest").alias("manifest"),
        )
    else:
        raise ValueError("layout is files or lines")
    return parse_manifests(texts)
