"""Saved reports: nested records per packet, and the same tables read back."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.limits import MAX_ITEMS, REPORT_VERSION
from quire.operators.scan import nest_rows, with_positions

PART_FIELDS = (
    "place bigint, item string, kind string, path string, pages bigint, first_page bigint, last_page bigint, label_start bigint, "
    "spans array<struct<src_first:bigint,src_last:bigint,out_first:bigint>>, "
    "page_sizes array<struct<first:bigint,last:bigint,width:double,height:double>>"
)
SECTION_FIELDS = "place bigint, item string, title string, parent string, first_page bigint, last_page bigint, target_page bigint"
FINDING_FIELDS = "place bigint, code string, severity string, file string, items array<string>"


def _fields(fields: str) -> list[tuple[str, str]]:
    """(name, type) pairs of a column list, in order."""
    schema = T._parse_datatype_string(fields)
    return [(f.name, f.dataType.simpleString()) for f in schema.fields]


def _struct(fields: str) -> str:
    return f"array<struct<{fields.replace(' bigint', ':bigint').replace(' string', ':string').replace(' array', ':array')}>>"


REPORT_SCHEMA = (
    "packet_id string, slice bigint, format_version int, status string, source_pages bigint, generated_pages bigint, total_pages bigint, "
    f"parts {_struct(PART_FIELDS)}, sections {_struct(SECTION_FIELDS)}, findings {_struct(FINDING_FIELDS)}"
)


class Reports(NamedTuple):
    headers: DataFrame
    parts: DataFrame
    spans: DataFrame
    page_runs: DataFrame
    sections: DataFrame
    label_spans: DataFrame
    findings: DataFrame


def _conform(rows: DataFrame, fields: str) -> DataFrame:
    """Only the report's columns; what a table lacks is null (unknown)."""
    columns = []
    for name, kind in _fields(fields):
        column = F.col(name) if name in rows.columns else F.lit(None)
        columns.append(column.cast(kind).alias(name))
    return rows.select(F.col("packet_id").cast("string").alias("packet_id"), *columns)


def report_records(headers: DataFrame, parts: DataFrame, sections: DataFrame, findings: DataFrame, slice_rows: int = MAX_ITEMS) -> DataFrame:
    """One record per packet with ordered arrays.

    A packet within the item limit is one record (slice 0); a larger one continues in further
    slices, so no record is unbounded and none is cut.  A resolved packet without rows has
    empty arrays, an unresolved one has nulls.

    ``parts`` and ``sections`` and ``findings`` carry ``order``, a sortable struct or number.
    """
    nested = []
    for rows, fields, out in ((parts, PART_FIELDS, "parts"), (sections, SECTION_FIELDS, "sections"), (findings, FINDING_FIELDS, "findings")):
        placed = with_positions(rows, ["packet_id"], ["order"], "place")
        nested.append(nest_rows(_conform(placed, fields), ["packet_id"], "place", [name for name, _ in _fields(fields)], out, slice_rows))
    joined = nested[0].join(nested[1], ["packet_id", "slice"], "full_outer").join(nested[2], ["packet_id", "slice"], "full_outer")
    header = headers.select(
        F.col("packet_id").cast("string").alias("packet_id"), "status",
        *[F.col(c).cast("bigint").alias(c) for c in ("source_pages", "generated_pages", "total_pages")],
    )
    known = F.col("total_pages").isNotNull()
    record = header.join(joined, "packet_id", "left")
    empty = lambda name: F.coalesce(F.col(name), F.when(known, F.array()).cast(record.schema[name].dataType))
    return record.select(
        "packet_id", F.coalesce(F.col("slice").cast("bigint"), F.lit(0)).alias("slice"), F.lit(REPORT_VERSION).alias("format_version"), "status",
        "source_pages", "generated_pages", "total_pages", empty("parts").alias("parts"), empty("sections").alias("sections"),
        F.coalesce("findings", F.array().cast(record.schema["findings"].dataType)).alias("findings"),
    )


def write_reports(records: DataFrame, path: str, mode: str = "errorifexists", partition_by: tuple = ()) -> None:
    """Write report records as JSON lines; nulls are written, so unknown differs from empty."""
    writer = records.write.mode(mode).option("ignoreNullFields", "false")
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)


def read_reports(spark: SparkSession, path: str) -> Reports:
    """Saved reports as tables again."""
    records = spark.read.schema(REPORT_SCHEMA).json(path)
    rows = lambda name: records.select("packet_id", F.explode(name).alias("r")).select("packet_id", "r.*")
    parts = rows("parts")
    spans = parts.select("packet_id", "place", F.explode("spans").alias("s")).select("packet_id", "place", "s.*")
    runs = parts.select("packet_id", "place", F.explode("page_sizes").alias("s")).select("packet_id", "place", "s.*")
    headers = records.filter(F.col("slice") == 0).select("packet_id", "format_version", "status", "source_pages", "generated_pages", "total_pages")
    labels = parts.select("packet_id", "place", "first_page", "last_page", "label_start")
    return Reports(headers, parts.drop("spans", "page_sizes"), spans, runs, rows("sections"), labels, rows("findings"))


class PublishRefused(ValueError):
    """The target exists or is an input of the job."""


def publish(df: DataFrame, path: str, inputs: list[str], overwrite: bool = False, format: str = "parquet") -> None:
    """Write a result without ever replacing one of the job's inputs.

    ``inputs`` names further paths the job reads, beside the files that ``df`` itself reads; a
    target equal to, inside or around one of them is refused, in whatever spelling.  An existing
    target is refused unless ``overwrite``.  The result is written beside the target and moved
    there when it is complete.
    """
    hadoop = df.sparkSession._jvm.org.apache.hadoop.fs
    settings = df.sparkSession._jsparkSession.sessionState().newHadoopConf()

    def qualified(name: str):
        given = hadoop.Path(name)
        return given.getFileSystem(settings).makeQualified(hadoop.Path(given.toUri().normalize()))

    def steps(name: str) -> list[str]:
        uri = qualified(name).toUri().normalize()
        return [f"{uri.getScheme()}://{uri.getAuthority() or ''}", *(s for s in uri.getPath().split("/") if s)]

    target = steps(path)
    for name in [*inputs, *df.inputFiles()]:
        source = steps(name)
        shorter = min(len(source), len(target))
        if source[:shorter] == target[:shorter]:
            raise PublishRefused(f"output_is_input: {path} overlaps {name}")
    folder = qualified(path)
    system = folder.getFileSystem(settings)
    if system.exists(folder) and not overwrite:
        raise PublishRefused(f"output_exists: {path}")
    staged = hadoop.Path(folder.getParent(), f".{folder.getName()}-{uuid.uuid4().hex}")
    df.write.format(format).save(staged.toString())
    if system.exists(folder):
        system.delete(folder, True)
    if not system.rename(staged, folder):
        raise PublishRefused(f"output_publish_failed: {path}")
