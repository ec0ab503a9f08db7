"""Removal of boilerplate lines by their frequency relative to their site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import stored

#: A line of a site is boilerplate if it stands on at least this share of the site's pages ...
RATIO = 0.1
#: ... and on at least this many of them.
LEAST_PAGES = 5
#: Boilerplate lines that may be broadcast; more are joined by shuffles.
MOST_BROADCAST = 100_000


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``_host``, ``_line`` (hash), ``n_pages`` and ``ratio`` of the boilerplate lines of every site.

    The pages that contain a line, each counted once, are divided by all pages of the site. A blank line is never
    boilerplate. Both counts are combined before their shuffle, so a site with a third of all pages does no harm.
    """
    known = pages.where(F.col(host).isNotNull()).select(F.col(host).alias("_host"), F.col(text).alias("_text"))
    totals = known.groupBy("_host").agg(F.count(F.lit(1)).alias("_total"))
    once = known.select("_host", F.explode(F.array_distinct(F.split("_text", "\n"))).alias("_l")).where("trim(_l) <> ''")
    counts = once.groupBy("_host", line_key("_l").alias("_line")).agg(F.count(F.lit(1)).alias("n_pages"))
    often = counts.where(F.col("n_pages") >= least_pages).join(totals, "_host")
    found = often.withColumn("ratio", F.col("n_pages") / F.col("_total")).where(F.col("ratio") >= ratio)
    return found.select("_host", "_line", "n_pages", "ratio")


def line_key(line: str):
    """128 bits of a line, which stand for it in shuffles."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def drop_boilerplate(pages: DataFrame, id: str = "doc_id", host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``pages`` with the boilerplate lines of their site removed from ``text``, and ``n_dropped``, how many went.

    All rows and columns stay, whatever their names (an ``n_dropped`` is replaced). A null text stays null; a page without a host belongs to no site and keeps all its
    lines, as does a page none of whose lines are boilerplate. A page that consists of boilerplate alone gets an
    empty text. Repeated rows count as pages of their own. The boilerplate of a host is one array, bounded by the
    lines of an average page divided by the ratio; few lines are broadcast, more are joined by host.
    """
    lines = stored(boilerplate(pages, host, text, ratio, least_pages), "lines")
    per_host = lines.groupBy("_host").agg(F.collect_set("_line").alias("_drop"))
    if lines.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        per_host = F.broadcast(per_host)
    kept = F.filter("_split", lambda x: ~F.array_contains("_drop", F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))))
    # the page's own columns are nested, so they may have any names
    names = [c for c in pages.columns if c != "n_dropped"]
    nested = pages.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_page"), F.split(text, "\n").alias("_split"))
    joined = nested.join(per_host, F.col("_page").getField(host) == F.col("_host"), "left").withColumn("_kept", F.when(F.col("_drop").isNotNull(), kept))
    less = F.coalesce(F.size("_split") - F.size("_kept"), F.lit(0))
    changed = joined.withColumn("_n", F.when(F.col("_kept").isNull(), 0).otherwise(less).cast("long"))
    field = lambda c: F.col("_page").getField(c)
    less_text = F.when(F.col("_n") > 0, F.array_join("_kept", "\n")).otherwise(field(text))
    return changed.select(*[(less_text if c == text else field(c)).alias(c) for c in names], F.col("_n").alias("n_dropped"))
