"""Binary sources: path, size, digest and a recognisable header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = "%PDF-"


def blob_facts(blobs: DataFrame, content: Column, header: str = HEADER) -> DataFrame:
    """Replace a content column by its facts; the header may stand anywhere in the bytes."""
    data = content.cast("binary")
    # Latin-1 maps every byte to one character, so positions count bytes.
    at = F.locate(header, F.decode(data, "ISO-8859-1"))
    return blobs.select(
        *[c for c in blobs.columns if c != "content"],
        F.octet_length(data).cast("bigint").alias("bytes"), F.sha2(data, 256).alias("digest"),
        (at > 0).alias("recognised"), F.when(at > 0, (at - 1).cast("bigint")).alias("header_at"),
    )


def scan_blobs(spark: SparkSession, glob: str, header: str = HEADER) -> DataFrame:
    """Facts of every file that matches; contents never leave the scanning task."""
    files = spark.read.format("binaryFile").load(glob).select("path", "content")
    return blob_facts(files, F.col("content"), header)
