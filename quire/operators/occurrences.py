"""Uses of sources: first-use order, consumers, shared analyses, per-packet facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.findings import length_prefixed
from quire.operators.scan import CarryLast, GroupFirst, RunningSum, scan, with_positions


def occurrences(events: DataFrame, split: bool | None = None) -> DataFrame:
    """The n-th use of every source of a packet, and the source's place in first-use order.

    First uses are flagged against a combined minimum, and both numbers are running sums, so
    a source or a packet of any size is spread over tasks.
    """
    used = events.filter(F.col("path").isNotNull())
    first = used.groupBy("packet_id", "path").agg(F.min("pos").alias("first_pos"))
    order = scan(first, ["packet_id"], ["first_pos"], [RunningSum("source_index", F.lit(1))], split)
    numbered = scan(used, ["packet_id", "path"], ["pos"], [RunningSum("use", F.lit(1))], False if split is False else None)
    return numbered.join(order, ["packet_id", "path"])


def distinct_sources(events: DataFrame) -> DataFrame:
    """Every source once, so that facts are computed once and joined back by path."""
    return events.filter(F.col("path").isNotNull()).select("path").distinct()


def resource_consumers(uses: DataFrame, split: bool | None = None) -> DataFrame:
    """Each resource with its distinct consumers in first-use order, one row per consumer.

    ``uses``: packet_id, path, role, ref, pos.  Rows, not arrays: a popular resource may have
    any number of consumers.
    """
    first = uses.groupBy("packet_id", "path", "ref").agg(F.min("pos").alias("pos"), F.min("role").alias("role"))
    return with_positions(first, ["packet_id", "path"], ["pos", "ref"], "ordinal", split)


def share_analyses(uses: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """Group uses whose analysis is the same: (distinct analyses, uses with their analysis key).

    ``fields`` are string columns that decide the result: source, normalised ranges, policy.
    An absent value differs from an empty one.
    """
    told = [F.when(F.col(f).isNull(), "-").otherwise(F.concat(F.lit("+"), f)) for f in fields]
    key = F.sha2(length_prefixed(F.array(*told)).cast("binary"), 256)
    keyed = uses.withColumn("analysis", key)
    return keyed.groupBy("analysis").agg(F.count(F.lit(1)).alias("uses"), *[F.min(f).alias(f) for f in fields]), keyed


def default_conflicts(parts: DataFrame, split: bool | None = None) -> DataFrame:
    """Sources with fields whose defaults differ from the first such source of the packet."""
    digest = F.when(F.col("has_fields"), F.col("defaults_digest"))
    first = scan(parts, ["packet_id"], ["pos"], [GroupFirst("_first", digest)], split)
    differing = first.filter(F.col("has_fields") & (F.col("defaults_digest") != F.col("_first")))
    return differing.select("packet_id", "pos", "path", F.lit("source_form_unsupported").alias("code"))


def packet_version(parts: DataFrame) -> DataFrame:
    """Highest version among the sources of a packet, and the first source that forces it."""
    forcing = F.when(F.col("version") == "2.0", F.col("pos"))
    return parts.groupBy("packet_id").agg(
        F.max("version").alias("version"), F.min_by("path", forcing).alias("forced_by")
    )


def source_identities(sources: DataFrame) -> DataFrame:
    """Established path, digest and size of every source."""
    return sources.select("path", "digest", "bytes").distinct()
