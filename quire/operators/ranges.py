"""Page ranges: merging, checking, selecting, expanding, mapping and looking up."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.scan import (
    CarryLast, Previous, RunningSum, exceeds_group_limit, islands, scan,
)

EXPAND_CHUNK = 10_000
#: Pages of a source that ranges are compared with at once.
SELECT_BLOCK = 256


def explode_ranges(items: DataFrame, keys: list[str], whole: str | None = None, extra: tuple = ()) -> DataFrame:
    """Range rows of every item with their ordinal; ``whole`` gives the page count that an
    absent selection covers."""
    ranges = F.col("ranges")
    if whole:
        every = F.array(F.struct(F.lit(1).cast("bigint").alias("first"), F.col(whole).alias("last")))
        ranges = F.coalesce(ranges, every)
    rows = items.select(*keys, *extra, F.posexplode(ranges).alias("ordinal", "r"))
    return rows.select(*keys, *extra, (F.col("ordinal") + 1).cast("bigint").alias("ordinal"), F.col("r.first").alias("first"), F.col("r.last").alias("last"))


def merge_ranges(ranges: DataFrame, keys: list[str], split: bool | None = None, extra: tuple = ()) -> DataFrame:
    """Join ranges that touch: the next one starts right after the last one ends.

    ``extra`` columns are constant within an item and kept.
    """
    runs = islands(
        ranges, keys, ["ordinal"], {"last": F.col("last")}, lambda prev: prev["last"] + 1 != F.col("first"), split=split
    )
    merged = runs.groupBy(*keys, "island").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), *[F.min(c).alias(c) for c in extra]
    )
    return merged.select(*keys, *extra, F.col("island").cast("bigint").alias("ordinal"), "first", "last")


def range_rejects(ranges: DataFrame, sources: DataFrame, keys: list[str], split: bool | None = None) -> DataFrame:
    """Ranges that are malformed or past the source, and partial use of a source with fields.

    ``ranges`` carries ``path``; ``sources`` has one row per path with pages and has_fields.  A
    well-formed range of a source without facts is a failed source.
    """
    looked = scan(ranges, keys, ["ordinal"], [Previous("_prev", F.col("last"))], split)
    facts = sources.select("path", F.col("pages").alias("_pages"), F.col("has_fields").alias("_fields"))
    joined = looked.join(facts, "path", "left")
    malformed = (F.col("first") < 1) | (F.col("last") < F.col("first")) | (F.col("first") <= F.coalesce("_prev", F.lit(0)))
    code = F.when(malformed, "plan_value").when(F.col("_pages").isNull(), "source_processing_failed").when(F.col("last") > F.col("_pages"), "source_selection_out_of_range")
    wrong = joined.select(*keys, "path", "ordinal", code.alias("code")).filter("code is not null")
    chosen = joined.groupBy(*keys, "path").agg(
        F.sum(F.col("last") - F.col("first") + 1).alias("_chosen"), F.first("_pages").alias("_pages"), F.first("_fields").alias("_fields")
    )
    partial = chosen.filter(F.col("_fields") & (F.col("_chosen") < F.col("_pages"))).select(
        *keys, "path", F.lit(0).cast("bigint").alias("ordinal"), F.lit("source_selection_form_unsupported").alias("code")
    )
    return wrong.unionByName(partial)


def selected_count(ranges: Column, whole: Column) -> Column:
    """Pages that a selection keeps; no selection keeps them all."""
    chosen = F.aggregate(ranges, F.lit(0).cast("bigint"), lambda total, r: total + r["last"] - r["first"] + 1)
    return F.coalesce(chosen, whole)


def span_map(parts: DataFrame, keys: list[str], ranges: DataFrame | None = None, split: bool | None = None) -> DataFrame:
    """Source range to output range; ``ordinal_first`` is the selected ordinal of its first page.

    Placed parts that carry their own ``ranges`` are unnested where they are: no join, and the
    partitioning by packet serves the running sum.  A separate ``ranges`` table is joined.
    """
    if ranges is None:
        ranges = merge_ranges(explode_ranges(parts, keys, "pages", ("first_page",)), keys, False, ("first_page",))
        split = False  # one array of one row is all there is in a group
    elif "first_page" not in ranges.columns:
        ranges = ranges.join(parts.select(*keys, "first_page"), keys)
    length = F.col("last") - F.col("first") + 1
    offset = scan(ranges, keys, ["ordinal"], [RunningSum("_offset", length, inclusive=False)], split)
    return offset.select(
        *[c for c in ranges.columns if c not in ("first", "last", "first_page")],
        F.col("first").alias("src_first"), F.col("last").alias("src_last"),
        (F.col("first_page") + F.col("_offset")).cast("bigint").alias("out_first"),
        (F.col("_offset") + 1).cast("bigint").alias("ordinal_first"),
    )


def span_mismatches(parts: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Parts whose page count differs from the pages their ranges select."""
    chosen = ranges.groupBy(*keys).agg(F.sum(F.col("last") - F.col("first") + 1).alias("selected"))
    return parts.join(chosen, keys).filter(F.col("selected") != F.col("pages")).select(*keys, "pages", "selected")


def expand_spans(spans: DataFrame, first: str, last: str, out: str, keys: list[str], chunk: int = EXPAND_CHUNK) -> DataFrame:
    """One row per page of every span.

    Spans are first cut into chunks and the compact chunks spread over the cluster, so one
    long span never becomes one long task.
    """
    cut = spans.withColumn("_from", F.explode(F.sequence(F.col(first), F.col(last), F.lit(chunk).cast("bigint"))))
    spread = cut.repartition(*keys, "_from")
    page = F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + (chunk - 1), F.col(last))))
    return spread.withColumn(out, page).drop("_from")


def expand_pages(parts: DataFrame, keys: list[str]) -> DataFrame:
    """One row per output page from compact parts."""
    return expand_spans(parts.filter(F.col("pages") > 0), "first_page", "last_page", "output_page", keys)


def block_of(page: Column) -> Column:
    """Number of the block of ``SELECT_BLOCK`` pages, from page 1 on, that holds a page."""
    return ((page - 1 - F.pmod(page - 1, F.lit(SELECT_BLOCK))) / SELECT_BLOCK).cast("bigint")


def select_pages(ranges: DataFrame, source_pages: DataFrame, keys: list[str], split: bool | None = None) -> DataFrame:
    """Original page rows that every occurrence keeps, with their selected ordinal.

    Ranges are cut where blocks of ``SELECT_BLOCK`` source pages end and meet the pages of their block: a popular source
    spreads over its blocks, no range is compared with more pages than a block has, and only compact ranges are shuffled.
    Both sides are sorted: how large exploded pages get cannot be told from the files they come from.
    """
    length = F.col("last") - F.col("first") + 1
    offset = scan(ranges, keys, ["ordinal"], [RunningSum("_offset", length, inclusive=False)], split)
    blocks = F.sequence(block_of(F.col("first")), block_of(F.col("last")))
    cut = offset.filter(F.col("last") >= F.col("first")).withColumn("_block", F.explode(blocks)).withColumnRenamed("path", "_path")
    pages = source_pages.withColumn("_of", block_of(F.col("page"))).hint("merge")
    held = (F.col("_path") == F.col("path")) & (F.col("_block") == F.col("_of")) & F.col("page").between(F.col("first"), F.col("last"))
    kept = [c for c in ranges.columns if c not in ("path", "first", "last")]
    rest = [c for c in source_pages.columns if c not in ("path", "page")]
    return cut.join(pages, held).select("path", "page", *kept, (F.col("_offset") + F.col("page") - F.col("first") + 1).alias("selected"), *rest)


def page_runs(pages: DataFrame, keys: list[str], split: bool | None = None) -> DataFrame:
    """Maximal runs of adjacent pages with exactly equal source and output size."""
    sizes = ["source_w", "source_h", "output_w", "output_h"]
    previous = {"page": F.col("page"), **{s: F.col(s) for s in sizes}}

    def breaks(prev):
        changed = prev["page"] + 1 != F.col("page")
        for name in sizes:
            changed = changed | ~prev[name].eqNullSafe(F.col(name))
        return changed

    runs = islands(pages, keys, ["page"], previous, breaks, split=split)
    return runs.groupBy(*keys, "island").agg(
        F.min("page").alias("first"), F.max("page").alias("last"), *[F.min(s).alias(s) for s in sizes]
    )


def lookup_at(
    points: DataFrame, spans: DataFrame, keys: list[str], point: str, first: str, last: str, fields: list[str],
    split: bool | None = None,
) -> DataFrame:
    """The span that covers each point, or nulls; spans of a group do not overlap.

    Points and span starts are merged in order and the nearest start is carried forward, so
    no point is ever compared with more than one span.
    """
    if split is None:
        split = exceeds_group_limit(spans, keys) or exceeds_group_limit(points, keys)
    distinct = points.select(*keys, point).distinct()
    payload = F.struct(F.col(last).alias("_last"), *[F.col(f).alias(f) for f in fields])
    starts = spans.select(*keys, F.col(first).alias("_at"), F.lit(0).alias("_side"), payload.alias("_span"))
    asks = distinct.select(*keys, F.col(point).alias("_at"), F.lit(1).alias("_side")).withColumn(
        "_span", F.lit(None).cast(starts.schema["_span"].dataType)
    )
    merged = scan(starts.unionByName(asks), keys, ["_at", "_side"], [CarryLast("_hit", F.col("_span"))], split)
    inside = F.col("_at") <= F.col("_hit._last")
    found = merged.filter(F.col("_side") == 1).select(
        *keys, F.col("_at").alias(point), *[F.when(inside, F.col(f"_hit.{f}")).alias(f) for f in fields]
    )
    return points.join(found, [*keys, point], "left")


def innermost_at(
    points: DataFrame, spans: DataFrame, keys: list[str], point: str, first: str, last: str, depth: str, fields: list[str],
    levels: int, split: bool | None = None,
) -> DataFrame:
    """The deepest span open at each point, or nulls; spans of a group are nested, those of one ``depth`` (0 to
    ``levels`` - 1) do not overlap.

    One ordered sweep over points and span starts carries the last start of every level; the deepest of these that has
    not ended covers the point. Points go through the sweep with all their columns, so nothing is joined to them afterwards.
    """
    if split is None:
        split = exceeds_group_limit(spans, keys) or exceeds_group_limit(points, keys)
    payload = F.struct(F.col(last).alias("_last"), *[F.col(f).alias(f"_span_{f}") for f in fields])
    starts = spans.select(*keys, F.col(first).alias("_at"), F.lit(0).alias("_side"), F.col(depth).alias("_level"), payload.alias("_span"))
    asks = points.withColumns({
        "_at": F.col(point), "_side": F.lit(1), "_level": F.lit(None).cast(starts.schema["_level"].dataType), "_span": F.lit(None).cast(starts.schema["_span"].dataType)})
    carried = [CarryLast(f"_open{d}", F.when(F.col("_level") == d, F.col("_span"))) for d in range(levels)]
    merged = scan(asks.unionByName(starts, allowMissingColumns=True), keys, ["_at", "_side", "_level"], carried, split).filter(F.col("_side") == 1)
    known = reduce(and_, [F.col(k).isNotNull() for k in keys])  # a group without a key has no spans
    hit = F.coalesce(*[F.when(known & (F.col(f"_open{d}._last") >= F.col("_at")), F.col(f"_open{d}")) for d in reversed(range(levels))])
    return merged.withColumn("_hit", hit).select(*points.columns, *[F.col(f"_hit._span_{f}").alias(f) for f in fields])


def partition_gaps(parts: DataFrame, keys: list[str], order: list[str], split: bool | None = None) -> DataFrame:
    """Places where parts do not follow each other exactly: expected and actual first page."""
    looked = scan(parts, keys, order, [Previous("_prev", F.col("last_page"))], split)
    expected = F.coalesce("_prev", F.lit(0)) + 1
    fault = F.when(F.col("first_page") > expected, "gap").when(F.col("first_page") < expected, "overlap")
    return looked.select(*keys, *order, expected.alias("expected_page"), "first_page", fault.alias("fault")).filter("fault is not null")
