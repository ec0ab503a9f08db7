"""Findings: identity, merging, ranking, status, caps and summaries.

A finding is a row ``packet_id, seq, code, file, identity_kind, phase, parameters, items,
setting, location``; ``seq`` is its unique place in the original order of the packet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.limits import (
    CLASS_PRIORITY, FINDING_CODES, PUBLICATION_FAILURES, STATUS_BY_PRIORITY, SUMMARY_LIMIT,
)
from quire.operators.scan import with_positions


def finding_codes(spark: SparkSession) -> DataFrame:
    """The code catalogue as a table: code, severity, class, priority.  A fixed few dozen rows."""
    rows = [
        (code, severity, kind, 4 if code in PUBLICATION_FAILURES else CLASS_PRIORITY.get(kind, 0))
        for code, (severity, kind) in FINDING_CODES.items()
    ]
    return spark.createDataFrame(rows, "code string, severity string, class string, priority int")


def with_codes(findings: DataFrame) -> DataFrame:
    """Add severity, class and priority; the catalogue is fixed and small, so it is broadcast.

    A code outside the catalogue fails the job: it must never pass for success.
    """
    known = findings.join(F.broadcast(finding_codes(findings.sparkSession)), "code", "left")
    unlisted = F.raise_error(F.concat(F.lit("unlisted finding code: "), F.coalesce("code", F.lit("null"))))
    return known.withColumns({"severity": F.coalesce("severity", unlisted.cast("string")), "priority": F.coalesce("priority", unlisted.cast("int"))})


def length_prefixed(values: Column) -> Column:
    """An unambiguous string of several strings."""
    return F.array_join(F.transform(values, lambda p: F.concat(F.octet_length(p).cast("string"), F.lit(":"), p)), "")


def finding_key(findings: DataFrame) -> DataFrame:
    """Identity of a finding: its kind, phase and parameters, but no wording; null without a kind."""
    parts = F.concat(F.array("identity_kind", F.coalesce("phase", F.lit(""))), F.col("parameters"))
    key = F.when(F.col("identity_kind").isNotNull(), F.sha2(length_prefixed(parts).cast("binary"), 256))
    return findings.withColumn("finding_key", key)


def merge_findings(findings: DataFrame, split: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """Merge warnings equal in code, file, identity and location: (findings, items).

    Errors, findings without file or identity, and findings that blame a setting stay alone.
    Items come back as rows, ``ordinal`` in first-seen order, because a merged group may name
    any number of them.  Duplicates are combined before the shuffle.  A merged group lies inside
    a packet, so a ``split`` measured on packets holds for it too.
    """
    keyed = finding_key(with_codes(findings))
    mergeable = (
        (F.col("severity") == "warning") & F.col("file").isNotNull() & F.col("finding_key").isNotNull() & F.col("setting").isNull()
    )
    parts = F.array("code", "file", "finding_key", F.when(F.col("location").isNull(), "-").otherwise(F.concat(F.lit("+"), "location")))
    group = F.when(mergeable, F.sha2(length_prefixed(parts).cast("binary"), 256)).otherwise(F.concat(F.lit("seq "), F.col("seq").cast("string")))
    grouped = keyed.withColumn("_group", group)
    shared = ["code", "severity", "class", "priority", "file", "identity_kind", "phase", "finding_key", "location", "setting"]
    merged = grouped.groupBy("packet_id", "_group").agg(
        F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("occurrences"), *[F.min(c).alias(c) for c in shared]
    )
    seen = (
        grouped.select("packet_id", "_group", "seq", F.posexplode(F.array_distinct("items")).alias("_at", "item"))
        .groupBy("packet_id", "_group", "item")
        .agg(F.min(F.struct("seq", "_at")).alias("_first"))
    )
    placed = with_positions(seen, ["packet_id", "_group"], ["_first"], "ordinal", split)
    items = placed.join(merged.select("packet_id", "_group", "first_seq"), ["packet_id", "_group"]).select(
        "packet_id", F.col("first_seq").alias("seq"), "ordinal", "item"
    )
    return merged.withColumnRenamed("first_seq", "seq").drop("_group"), items


def distinct_in_order(df: DataFrame, column: str) -> DataFrame:
    """Distinct array elements in first-seen order."""
    return df.withColumn(column, F.array_distinct(column))


def rank_findings(findings: DataFrame, split: bool | None = None) -> DataFrame:
    """Rank by priority, ties in original order."""
    ranked = findings if "priority" in findings.columns else with_codes(findings)
    return with_positions(ranked, ["packet_id"], [F.col("priority").desc(), F.col("seq")], "rank", split)


def packet_status(packets: DataFrame, findings: DataFrame) -> DataFrame:
    """Worst outcome of every packet; packets without findings are ok."""
    ranked = findings if "priority" in findings.columns else with_codes(findings)
    outcome = F.when(F.col("severity") == "error", F.coalesce(*[
        F.when(F.col("class") == kind, F.lit(priority)) for kind, priority in CLASS_PRIORITY.items()
    ])).otherwise(0)
    worst = ranked.groupBy("packet_id").agg(F.max(outcome).alias("_worst"))
    level = F.coalesce("_worst", F.lit(0))
    status = F.coalesce(*[F.when(level == priority, status) for priority, status in STATUS_BY_PRIORITY.items()])
    return packets.select("packet_id").distinct().join(worst, "packet_id", "left").select("packet_id", status.alias("status"))


def cap_findings(findings: DataFrame, items: DataFrame, limit: int = SUMMARY_LIMIT) -> DataFrame:
    """The top findings of every packet with at most ``limit`` items each, and how much was left out.

    Ranking with a bound is cut down inside every task before the shuffle, so a packet with
    very many findings costs no more than ``limit`` rows per task.
    """
    order = Window.partitionBy("packet_id").orderBy(F.col("priority").desc(), F.col("seq"))
    top = findings.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    totals = findings.groupBy("packet_id").agg(F.count(F.lit(1)).alias("_total"))
    shown = items.filter(F.col("ordinal") <= limit).groupBy("packet_id", "seq").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "item"))), lambda x: x["item"]).alias("items")
    )
    counts = items.groupBy("packet_id", "seq").agg(F.count(F.lit(1)).alias("_items"))
    return (
        top.join(totals, "packet_id").join(shown, ["packet_id", "seq"], "left").join(counts, ["packet_id", "seq"], "left")
        .select(
            "packet_id", F.col("rank").cast("bigint").alias("rank"), "seq", "code", "severity", "file", "occurrences", "items",
            F.greatest(F.coalesce("_items", F.lit(0)) - limit, F.lit(0)).alias("items_omitted"),
            F.greatest(F.col("_total") - limit, F.lit(0)).alias("findings_omitted"),
        )
    )


def preview_rows(sections: DataFrame, parts: DataFrame, limit: int = SUMMARY_LIMIT) -> DataFrame:
    """Sections first, then parts, at most ``limit`` rows per packet, with the omitted count."""
    rows = sections.select("packet_id", F.lit("section").alias("row"), "pos", "ref", "first_page", "last_page").unionByName(
        parts.select("packet_id", F.lit("part").alias("row"), "pos", "ref", "first_page", "last_page")
    )
    order = Window.partitionBy("packet_id").orderBy((F.col("row") == "part").cast("int"), "pos", "first_page")
    top = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    totals = rows.groupBy("packet_id").agg(F.count(F.lit(1)).alias("_total"))
    return top.join(totals, "packet_id").withColumn("omitted", F.greatest(F.col("_total") - limit, F.lit(0))).drop("_total")


def coverage_status(parts: DataFrame) -> DataFrame:
    """none / partial / complete structure coverage; a discarded structure is none.

    Expects ``structure`` (policy), ``covered`` and ``uncovered`` flags per part.
    """
    flags = parts.groupBy("packet_id").agg(
        F.max("structure").alias("_policy"), F.bool_or("covered").alias("_some"), F.bool_or("uncovered").alias("_gaps")
    )
    status = F.when((F.col("_policy") == "discard") | ~F.coalesce("_some", F.lit(False)), "none").when(F.col("_gaps"), "partial").otherwise("complete")
    return flags.select("packet_id", status.alias("coverage"))


def findings_summary(findings: DataFrame) -> DataFrame:
    """Counts per code, severity, class and file."""
    ranked = findings if "severity" in findings.columns else with_codes(findings)
    return ranked.groupBy("code", "severity", "class", "file").agg(
        F.count(F.lit(1)).alias("findings"), F.countDistinct("packet_id").alias("packets")
    )


def first_fault(findings: DataFrame) -> DataFrame:
    """Only the first fault of every packet in document order (``offset``, then ``seq``)."""
    rest = [c for c in findings.columns if c != "packet_id"]
    first = findings.groupBy("packet_id").agg(F.min_by(F.struct(*rest), F.struct("offset", "seq")).alias("_first"))
    return first.select("packet_id", "_first.*")
