"""Layout and range queries over orders seen as packets."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import layout, ranges
from quire.operators.scan import RunningSum, scan, task_count
from quire.plans import fixtures as fx
from quire.plans.registry import query, statement

PART = ["packet_id", "pos", "band"]


def placed_parts(spark, sf_dir):
    """Padded and placed parts of every packet, one row per part."""
    items, split = fx.order_items(spark, sf_dir)
    events = layout.pad_odd_starts(items, keep=("mode", "start"), split=split)
    parts = layout.place_parts(events, split)
    enabled = F.coalesce(F.col("numbering"), F.lit(True)) & (F.col("kind") != "padding")
    return parts.withColumn("enabled", enabled), split


@query("pad_odd_starts", statement(fx.FX2, fx.FX2_FOLD, recursive=True, body="""
SELECT packet_id, pos, band::BIGINT AS band, kind, pages FROM parts"""))
def pad_odd_starts(spark, sf_dir):
    items, split = fx.order_items(spark, sf_dir)
    events = layout.pad_odd_starts(items, split=split)
    return events.select("packet_id", "pos", F.col("band").cast("bigint").alias("band"), "kind", "pages")


@query("place_parts", statement(fx.FX2, fx.FX2_FOLD, recursive=True, body="""
SELECT packet_id, pos, band::BIGINT AS band, kind, first_page, last_page FROM parts"""))
def place_parts(spark, sf_dir):
    parts, _ = placed_parts(spark, sf_dir)
    return parts.select("packet_id", "pos", F.col("band").cast("bigint").alias("band"), "kind", "first_page", "last_page")


LABELLED = """labelled AS (
  SELECT *, CASE WHEN mode IS NULL THEN first_page
                 WHEN NOT enabled OR kind = 'padding' THEN NULL
                 WHEN mode = 'physical' THEN start + first_page - 1
                 ELSE start + coalesce(sum(CASE WHEN enabled AND kind <> 'padding' THEN pages ELSE 0 END) OVER (
                   PARTITION BY packet_id ORDER BY pos, band ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            END::BIGINT AS label_start
  FROM parts)"""


@query("label_pages", statement(fx.FX2, fx.FX2_FOLD, LABELLED, recursive=True, body="""
SELECT packet_id, pos, band::BIGINT AS band, kind, first_page, last_page, label_start,
       coalesce(label_start::VARCHAR, '—') AS first_label FROM labelled"""))
def label_pages(spark, sf_dir):
    parts, split = placed_parts(spark, sf_dir)
    labelled = layout.label_pages(parts, split=split)
    return labelled.select(
        "packet_id", "pos", F.col("band").cast("bigint").alias("band"), "kind", "first_page", "last_page", "label_start",
        layout.label_at(F.col("first_page"), F.col("first_page"), F.col("label_start")).alias("first_label"),
    )


KINDED = LABELLED.replace("enabled AND kind <> 'padding'", "enabled AND kind = 'source'").replace(
    "NOT enabled OR kind = 'padding'", "NOT enabled OR kind <> 'source'")


@query("label_pages_by_kind", statement(fx.FX2, fx.FX2_FOLD, KINDED, recursive=True, body="""
SELECT packet_id, pos, band::BIGINT AS band, label_start FROM labelled"""))
def label_pages_by_kind(spark, sf_dir):
    parts, split = placed_parts(spark, sf_dir)
    labelled = layout.label_pages(parts, F.array(F.lit("source")), split)
    return labelled.select("packet_id", "pos", F.col("band").cast("bigint").alias("band"), "label_start")


@query("label_spans", statement(fx.FX2, fx.FX2_FOLD, LABELLED, """marked AS (
  SELECT *, CASE WHEN lag(first_page) OVER w IS NULL
                 OR (lag(label_start - first_page) OVER w) IS DISTINCT FROM (label_start - first_page) THEN 1 ELSE 0 END AS starts
  FROM labelled WINDOW w AS (PARTITION BY packet_id ORDER BY pos, band)),
runs AS (SELECT *, sum(starts) OVER (PARTITION BY packet_id ORDER BY pos, band) AS island FROM marked)""", recursive=True, body="""
SELECT packet_id, min(first_page) AS first_page, max(last_page) AS last_page, min(label_start) AS label_start
FROM runs GROUP BY packet_id, island"""))
def label_spans(spark, sf_dir):
    parts, split = placed_parts(spark, sf_dir)
    spans = layout.label_spans(layout.label_pages(parts, split=split), split)
    return spans.select("packet_id", "first_page", "last_page", "label_start")


LABEL_MAXIMUM = 100


@query("label_overflow", statement(fx.FX2, fx.FX2_FOLD, LABELLED, f"""paged AS (
  SELECT packet_id, unnest(range(first_page, last_page + 1)) AS page, first_page, label_start, mode, last_page
  FROM labelled WHERE label_start IS NOT NULL AND mode IS NOT NULL)""", recursive=True, body=f"""
SELECT packet_id, min(page) FILTER (label_start + page - first_page > {LABEL_MAXIMUM}) AS page,
       {LABEL_MAXIMUM} - (CASE WHEN min(mode) = 'consecutive' THEN count(*) ELSE max(page) END - 1) AS largest_start
FROM paged GROUP BY packet_id HAVING max(label_start + page - first_page) > {LABEL_MAXIMUM}"""))
def label_overflow(spark, sf_dir):
    parts, split = placed_parts(spark, sf_dir)
    return layout.label_overflow(parts, LABEL_MAXIMUM, split=split)


@query("label_width_bound", statement(fx.FX2, body="""
SELECT packet_id, bound, CASE WHEN any_page THEN length(greatest(bound, 1)::VARCHAR) ELSE 0 END AS digits
FROM (SELECT packet_id, (sum(pages) + count(*) FILTER (odd) + coalesce(min(start) - 1, 0))::BIGINT AS bound,
             min(mode) IS NULL OR bool_or(coalesce(numbering, true)) AS any_page
      FROM fx2 GROUP BY packet_id)"""))
def label_width_bound(spark, sf_dir):
    items, _ = fx.order_items(spark, sf_dir)
    return layout.label_width_bound(items.withColumn("enabled", F.coalesce("numbering", F.lit(True))))


@query("page_totals", statement(fx.FX2, fx.FX2_FOLD, recursive=True, body="""
SELECT packet_id, coalesce(sum(pages) FILTER (kind = 'source'), 0)::BIGINT AS source_pages,
       coalesce(sum(pages) FILTER (kind <> 'source'), 0)::BIGINT AS generated_pages, sum(pages)::BIGINT AS total_pages
FROM parts GROUP BY packet_id"""))
def page_totals(spark, sf_dir):
    parts, _ = placed_parts(spark, sf_dir)
    return layout.page_totals(parts)


@query("page_totals_unknown", statement(fx.FX2, body="""
SELECT packet_id,
       CASE WHEN bool_or(kind = 'source' AND l_suppkey % 5 = 0) THEN NULL ELSE coalesce(sum(pages) FILTER (kind = 'source'), 0) END::BIGINT AS source_pages,
       coalesce(sum(pages) FILTER (kind <> 'source'), 0)::BIGINT AS generated_pages,
       CASE WHEN bool_or(kind = 'source' AND l_suppkey % 5 = 0) THEN NULL ELSE sum(pages) END::BIGINT AS total_pages
FROM fx2 GROUP BY packet_id"""))
def page_totals_unknown(spark, sf_dir):
    """Sources of some suppliers are not inspected yet, so their page counts are unknown."""
    items, _ = fx.order_items(spark, sf_dir)
    unknown = (F.col("kind") == "source") & (F.col("l_suppkey") % 5 == 0)
    return layout.page_totals(items.withColumn("pages", F.when(~unknown, F.col("pages"))))


SIZED = """sized AS (
  SELECT p.packet_id, p.pos, p.band, p.kind, i.width, i.height,
         CASE WHEN p.kind = 'source' THEN {'w': i.width, 'h': i.height} END AS src
  FROM parts p JOIN fx2 i USING (packet_id, pos)),
chosen AS (
  SELECT *, CASE WHEN kind = 'source' THEN src WHEN kind = 'padding' THEN NULL
                 WHEN width IS NOT NULL THEN {'w': width, 'h': height}
                 ELSE coalesce(last_value(src IGNORE NULLS) OVER (PARTITION BY packet_id ORDER BY pos, band ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                               first_value(src IGNORE NULLS) OVER (PARTITION BY packet_id ORDER BY pos, band ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) END AS size
  FROM sized),
under AS (
  SELECT *, last_value(size IGNORE NULLS) OVER (PARTITION BY packet_id ORDER BY pos, band ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sheet FROM chosen)"""


@query("inherit_sizes", statement(fx.FX2, fx.FX2_FOLD, SIZED, recursive=True, body="""
SELECT packet_id, pos, band::BIGINT AS band, kind, CASE WHEN kind = 'padding' THEN sheet ELSE size END.w AS size_w,
       CASE WHEN kind = 'padding' THEN sheet ELSE size END.h AS size_h FROM under"""))
def inherit_sizes(spark, sf_dir):
    sized, _ = layout.inherit_sizes(*sized_events(spark, sf_dir))
    return sized.select("packet_id", "pos", F.col("band").cast("bigint").alias("band"), "kind", "size_w", "size_h")


def sized_events(spark, sf_dir, fit=None):
    items, split = fx.order_items(spark, sf_dir)
    source = F.col("kind") == "source"
    facts = items.withColumn("first_w", F.when(source, F.col("width"))).withColumn("first_h", F.when(source, F.col("height")))
    facts = facts.withColumn("last_w", F.col("first_w")).withColumn("last_h", F.col("first_h"))
    return layout.pad_odd_starts(facts, split=split), fit, split


def _fit(w, h):
    goal = f"{fx.FIT_TOLERANCE}"
    return (f"NOT ({w} BETWEEN {fx.FIT_W} - {goal} AND {fx.FIT_W} + {goal} AND {h} BETWEEN {fx.FIT_H} - {goal} AND {fx.FIT_H} + {goal})")


@query("inherit_sizes_fitted", statement(fx.FX2, fx.FX2_FOLD, f"""sheets AS (
  SELECT p.packet_id, p.pos, p.band, p.kind,
         CASE WHEN p.kind = 'padding' THEN NULL
              WHEN p.kind = 'page' AND i.width IS NULL THEN {{'w': {fx.FIT_W}::DOUBLE, 'h': {fx.FIT_H}::DOUBLE}}
              WHEN {_fit('i.width', 'i.height')} THEN {{'w': {fx.FIT_W}::DOUBLE, 'h': {fx.FIT_H}::DOUBLE}}
              ELSE {{'w': i.width, 'h': i.height}} END AS sheet
  FROM parts p JOIN fx2 i USING (packet_id, pos))""", recursive=True, body="""
SELECT packet_id, pos, band::BIGINT AS band, r.w AS output_w, r.h AS output_h FROM (
  SELECT *, coalesce(sheet, last_value(sheet IGNORE NULLS) OVER (
    PARTITION BY packet_id ORDER BY pos, band ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS r FROM sheets)"""))
def inherit_sizes_fitted(spark, sf_dir):
    policy = (fx.FIT_W, fx.FIT_H, fx.FIT_TOLERANCE)
    sized, _ = layout.inherit_sizes(*sized_events(spark, sf_dir, policy))
    return sized.select("packet_id", "pos", F.col("band").cast("bigint").alias("band"), "output_w", "output_h")


@query("inherit_size_findings", statement(fx.FX2, fx.FX2_FOLD, SIZED, recursive=True, body="""
SELECT packet_id, pos, band::BIGINT AS band, 'page_size_required' AS code FROM under WHERE CASE WHEN kind = 'padding' THEN sheet ELSE size END.w IS NULL"""))
def inherit_size_findings(spark, sf_dir):
    """Pages and blanks that inherit from nothing: no source and no sized sheet before them."""
    _, findings = layout.inherit_sizes(*sized_events(spark, sf_dir))
    return findings.select("packet_id", "pos", F.col("band").cast("bigint").alias("band"), "code")


# --- ranges ---------------------------------------------------------------------------

RANGES = """ranged AS MATERIALIZED (
  SELECT packet_id, pos, path, source_pages, has_fields, l_partkey, unnest(range(1, len(rs) + 1)) AS ordinal, unnest(rs).first AS first, unnest(rs).last AS last
  FROM (SELECT *, coalesce(ranges, [{'first': 1::BIGINT, 'last': source_pages}]) AS rs FROM fx2 WHERE kind = 'source'))"""
MERGED = """merged AS MATERIALIZED (
  SELECT packet_id, pos, path, row_number() OVER (PARTITION BY packet_id, pos ORDER BY min(first)) AS ordinal, min(first) AS first, max(last) AS last
  FROM (SELECT *, sum(b) OVER (PARTITION BY packet_id, pos ORDER BY ordinal) AS g FROM (
    SELECT *, CASE WHEN lag(last) OVER (PARTITION BY packet_id, pos ORDER BY ordinal) + 1 = first THEN 0 ELSE 1 END AS b FROM ranged))
  GROUP BY packet_id, pos, path, g)"""
ITEM = ["packet_id", "pos"]


def source_ranges(spark, sf_dir, extra=("path",)):
    items, split = fx.order_items(spark, sf_dir)
    sources = items.filter(F.col("kind") == "source")
    return ranges.explode_ranges(sources, ITEM, "source_pages", extra), items, split


@query("merge_ranges", statement(fx.FX2, RANGES, MERGED, body="SELECT packet_id, pos, ordinal, first, last FROM merged"))
def merge_ranges(spark, sf_dir):
    rows, _, _ = source_ranges(spark, sf_dir, ())
    # a group is the array of one item row
    return ranges.merge_ranges(rows, ITEM, False)


@query("range_rejects", statement(fx.FX2, RANGES, """shelf AS (
  SELECT 'part/' || p_partkey AS path, CASE WHEN p_partkey % 9 = 0 THEN p_size - 1 ELSE p_size END::BIGINT AS pages, p_size % 4 = 0 AS has_fields FROM part)""", body="""
SELECT packet_id, pos, ordinal, 'source_selection_out_of_range' AS code FROM ranged JOIN shelf USING (path) WHERE last > pages
UNION ALL
SELECT packet_id, pos, 0, 'source_selection_form_unsupported' FROM (
  SELECT packet_id, pos, sum(last - first + 1) AS n, any_value(s.pages) AS pages FROM ranged r JOIN shelf s USING (path) WHERE s.has_fields GROUP BY packet_id, pos)
WHERE n < pages"""))
def range_rejects(spark, sf_dir):
    """Checks every selection against sources some of which lost their last page."""
    rows, _, _ = source_ranges(spark, sf_dir)
    part = fx.table(spark, sf_dir, "part")
    size = F.col("p_size").cast("bigint")
    sources = part.select(
        F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("path"),
        F.when(F.col("p_partkey") % 9 == 0, size - 1).otherwise(size).alias("pages"),
        (F.col("p_size") % 4 == 0).alias("has_fields"),
    )
    return ranges.range_rejects(rows, fx.dealt_sources(spark, sf_dir, sources), ITEM, False).select("packet_id", "pos", "ordinal", "code")


SELECTED = """picked AS (
  SELECT packet_id, pos, path, ordinal, unnest(range(first, last + 1)) AS page FROM merged),
selected AS (
  SELECT *, row_number() OVER (PARTITION BY packet_id, pos ORDER BY page) AS selected FROM picked)"""


@query("select_pages", statement(fx.FX2, RANGES, MERGED, fx.PART_PAGES, SELECTED, body="""
SELECT packet_id, count(*) AS pages, sum(page)::BIGINT AS page_sum, sum(page * selected)::BIGINT AS weighted, sum(width)::DOUBLE AS width_sum
FROM selected JOIN part_pages USING (path, page) GROUP BY packet_id"""))
def select_pages(spark, sf_dir):
    """Every selected original page, digested per packet."""
    rows, _, _ = source_ranges(spark, sf_dir)
    pages = ranges.select_pages(rows, fx.part_pages(spark, sf_dir), ITEM, False)
    return pages.groupBy("packet_id").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("page").alias("page_sum"),
        F.sum(F.col("page") * F.col("selected")).alias("weighted"), F.sum("width").alias("width_sum"),
    )


@query("expand_pages", statement(fx.FX2, fx.FX2_FOLD, recursive=True, body="""
SELECT packet_id, kind, count(*) AS pages, sum(page)::BIGINT AS page_sum, sum(page * page)::BIGINT AS squares
FROM (SELECT packet_id, kind, unnest(range(first_page, last_page + 1)) AS page FROM parts) GROUP BY ALL"""))
def expand_pages(spark, sf_dir):
    parts, _ = placed_parts(spark, sf_dir)
    pages = ranges.expand_pages(parts.select(*PART, "kind", "pages", "first_page", "last_page"), PART)
    return pages.groupBy("packet_id", "kind").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("output_page").alias("page_sum"),
        F.sum(F.col("output_page") * F.col("output_page")).alias("squares"),
    )


def selected_parts(spark, sf_dir):
    """Packets whose sources contribute only their selected pages, placed in output order."""
    items, split = fx.order_items(spark, sf_dir)
    sized = items.withColumn("pages", ranges.selected_count(F.col("ranges"), F.col("pages")))
    parts = layout.place_parts(layout.pad_odd_starts(sized, keep=("mode", "start"), split=split), split)
    enabled = F.coalesce(F.col("numbering"), F.lit(True)) & (F.col("kind") != "padding")
    return parts.withColumn("enabled", enabled), split


CHOSEN_FX2 = fx.FX2.replace("fx2 AS MATERIALIZED", "base2 AS MATERIALIZED")
CHOSEN = """fx2 AS MATERIALIZED (
  SELECT * EXCLUDE (pages), CASE WHEN kind = 'page' THEN pages WHEN ranges IS NULL THEN source_pages
    ELSE list_sum(list_transform(ranges, lambda r: r.last - r.first + 1))::BIGINT END AS pages FROM base2)"""
SPANNED = """spanned AS MATERIALIZED (
  SELECT m.packet_id, m.pos, m.first AS src_first, m.last AS src_last,
         p.first_page + coalesce(sum(m.last - m.first + 1) OVER (PARTITION BY m.packet_id, m.pos ORDER BY m.ordinal
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS out_first
  FROM merged m JOIN parts p ON p.packet_id = m.packet_id AND p.pos = m.pos AND p.band = 1)"""


@query("span_map", statement(CHOSEN_FX2, CHOSEN, fx.FX2_FOLD, RANGES, MERGED, SPANNED, recursive=True, body="""
SELECT packet_id, pos, src_first, src_last, out_first, out_first + src_last - src_first AS out_last FROM spanned"""))
def span_map(spark, sf_dir):
    parts, _ = selected_parts(spark, sf_dir)
    spans = ranges.span_map(parts.filter(F.col("kind") == "source"), ITEM)
    return spans.select("packet_id", "pos", "src_first", "src_last", "out_first",
                        (F.col("out_first") + F.col("src_last") - F.col("src_first")).alias("out_last"))


@query("span_mismatches", statement(fx.FX2, body="""
SELECT packet_id, pos, pages, list_sum(list_transform(ranges, lambda r: r.last - r.first + 1))::BIGINT AS selected
FROM fx2 WHERE kind = 'source' AND ranges IS NOT NULL"""))
def span_mismatches(spark, sf_dir):
    """Parts that still claim the whole source although ranges select fewer pages."""
    rows, items, _ = source_ranges(spark, sf_dir, ())
    return ranges.span_mismatches(items.filter(F.col("kind") == "source"), rows, ITEM)


@query("page_runs", statement(fx.FX2, fx.PART_PAGES, f"""fitted AS (
  SELECT path, page, width, height, CASE WHEN {_fit('width', 'height')} THEN {fx.FIT_W}::DOUBLE ELSE width END AS ow,
         CASE WHEN {_fit('width', 'height')} THEN {fx.FIT_H}::DOUBLE ELSE height END AS oh FROM part_pages WHERE page % 4 <> 0),
islands AS (
  SELECT *, page - row_number() OVER (PARTITION BY path, width, height, ow, oh ORDER BY page) AS g FROM fitted)""", body="""
SELECT path, min(page) AS first, max(page) AS last, width AS source_w, height AS source_h, ow AS output_w, oh AS output_h
FROM islands GROUP BY path, width, height, ow, oh, g"""))
def page_runs(spark, sf_dir):
    """Size runs of selections that leave out every fourth page."""
    from quire.operators.geometry import fit_decisions

    pages = fx.part_pages(spark, sf_dir).filter(F.col("page") % 4 != 0)
    fitted = fit_decisions(pages, F.lit(fx.FIT_W), F.lit(fx.FIT_H), F.lit(fx.FIT_TOLERANCE))
    named = fitted.withColumnsRenamed({"width": "source_w", "height": "source_h"})
    runs = ranges.page_runs(named, ["path"])
    return runs.select("path", "first", "last", "source_w", "source_h", "output_w", "output_h")


@query("lookup_at", statement(fx.FX2, fx.FX2_FOLD, LABELLED, """asked AS (
  SELECT packet_id, line * 9 AS page FROM fx2)""", recursive=True, body="""
SELECT a.packet_id, a.page, l.pos, l.kind, (l.label_start + a.page - l.first_page)::BIGINT AS label
FROM asked a LEFT JOIN labelled l ON l.packet_id = a.packet_id AND a.page BETWEEN l.first_page AND l.last_page"""))
def lookup_at(spark, sf_dir):
    """Which part covers page 9, 18, 27, ... of each packet, and its label; past the end: nothing."""
    parts, split = placed_parts(spark, sf_dir)
    labelled = layout.label_pages(parts, split=split)
    items, _ = fx.order_items(spark, sf_dir)
    points = items.select("packet_id", (F.col("line") * 9).alias("page"))
    found = ranges.lookup_at(points, labelled, ["packet_id"], "page", "first_page", "last_page", ["pos", "kind", "first_page", "label_start"], split)
    return found.select("packet_id", "page", "pos", "kind", (F.col("label_start") + F.col("page") - F.col("first_page")).alias("label"))


SHIFTED = "first_page, last_page + CASE WHEN l_suppkey % 13 = 0 THEN 1 WHEN l_suppkey % 17 = 0 THEN -1 ELSE 0 END"


@query("partition_gaps", statement(fx.FX2, fx.FX2_FOLD, """shaken AS (
  SELECT p.packet_id, p.pos, p.band, p.first_page, p.last_page + CASE WHEN p.band = 0 THEN 0 WHEN i.l_suppkey % 13 = 0 THEN 1 WHEN i.l_suppkey % 17 = 0 THEN -1 ELSE 0 END AS last_page
  FROM parts p JOIN fx2 i USING (packet_id, pos))""", recursive=True, body="""
SELECT packet_id, pos, expected_page, first_page, CASE WHEN first_page > expected_page THEN 'gap' ELSE 'overlap' END AS fault
FROM (SELECT *, 1 + coalesce(lag(last_page) OVER (PARTITION BY packet_id ORDER BY pos, band), 0) AS expected_page FROM shaken)
WHERE first_page <> expected_page"""))
def partition_gaps(spark, sf_dir):
    """Finds the parts whose recorded last page was shifted by one."""
    parts, split = placed_parts(spark, sf_dir)
    shift = F.when(F.col("l_suppkey") % 13 == 0, 1).when(F.col("l_suppkey") % 17 == 0, -1).otherwise(0)
    shaken = parts.withColumn("last_page", F.col("last_page") + F.coalesce(shift, F.lit(0)))
    gaps = ranges.partition_gaps(shaken, ["packet_id"], ["pos", "band"], split)
    return gaps.select("packet_id", "pos", "expected_page", "first_page", "fault")


@query("page_map", statement(CHOSEN_FX2, CHOSEN, fx.FX2_FOLD, LABELLED, RANGES, MERGED, SPANNED, """mapped AS (
  SELECT packet_id, kind, first_page, label_start, unnest(range(first_page, last_page + 1)) AS page, NULL::BIGINT AS src, first_page AS origin FROM labelled WHERE kind <> 'source'
  UNION ALL
  SELECT l.packet_id, l.kind, l.first_page, l.label_start, unnest(range(out_first, out_first + src_last - src_first + 1)), src_first, out_first
  FROM labelled l JOIN spanned s ON s.packet_id = l.packet_id AND s.pos = l.pos AND l.kind = 'source')""", recursive=True, body="""
SELECT packet_id, kind, count(*) AS pages, sum(page)::BIGINT AS page_sum, sum((src + page - origin) * page)::BIGINT AS source_sum,
       sum((label_start + page - first_page))::BIGINT AS label_sum, count(*) FILTER (label_start IS NULL) AS unlabelled
FROM mapped GROUP BY packet_id, kind"""))
def page_map(spark, sf_dir):
    """The full trace table, digested per packet and kind."""
    pages = full_page_map(spark, sf_dir, ("label_start", "first_page"))
    # numbers as numbers: writing and reading every label as a text took most of the time
    number = F.col("label_start") + F.col("output_page") - F.col("first_page")
    return pages.groupBy("packet_id", "kind").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("output_page").alias("page_sum"),
        F.sum(F.col("source_page") * F.col("output_page")).alias("source_sum"),
        F.sum(number).alias("label_sum"), F.count(F.when(F.col("label_start").isNull(), 1)).alias("unlabelled"),
    )


def full_page_map(spark, sf_dir, keep=()):
    parts, split = selected_parts(spark, sf_dir)
    labelled = layout.label_pages(parts, split=split)
    return layout.page_map(labelled.select(*PART, "kind", "path", "ref", "pages", "ranges", "first_page", "last_page", "label_start"), keep)


TRACE_SECTIONS = """spans AS (
  SELECT packet_id, 0 AS depth, 'a/' || (pos - 1) // 4 AS section, min(first_page) AS first_page, max(last_page) AS last_page FROM labelled WHERE band = 1 GROUP BY ALL
  UNION ALL
  SELECT packet_id, 1, 'b/' || (pos - 1) // 2, min(first_page), max(last_page) FROM labelled WHERE band = 1 AND (pos - 1) // 2 % 2 = 0 GROUP BY ALL)"""


@query("page_trace", statement(CHOSEN_FX2, CHOSEN, fx.FX2_FOLD, LABELLED, RANGES, MERGED, SPANNED, fx.PART_PAGES, TRACE_SECTIONS, """uses AS (
  SELECT packet_id, pos, row_number() OVER (PARTITION BY packet_id, path ORDER BY pos) AS occurrence FROM fx2 WHERE path IS NOT NULL),
traced AS MATERIALIZED (
  SELECT packet_id, pos, band, kind, unnest(range(first_page, last_page + 1)) AS page, NULL::BIGINT AS source_page, NULL::VARCHAR AS path FROM labelled WHERE kind <> 'source'
  UNION ALL
  SELECT l.packet_id, l.pos, l.band, l.kind, unnest(range(out_first, out_first + src_last - src_first + 1)), unnest(range(src_first, src_last + 1)), f.path
  FROM labelled l JOIN spanned s ON s.packet_id = l.packet_id AND s.pos = l.pos AND l.kind = 'source' JOIN fx2 f ON f.packet_id = l.packet_id AND f.pos = l.pos),
within AS MATERIALIZED (
  SELECT t.packet_id, t.page, arg_max(section, depth) AS section FROM traced t JOIN spans s ON s.packet_id = t.packet_id AND page BETWEEN first_page AND last_page GROUP BY ALL)""", recursive=True, body="""
SELECT t.packet_id, t.pos, t.band::BIGINT AS band, t.kind, occurrence, section, count(*) AS pages, sum(t.page)::BIGINT AS page_sum, sum(t.source_page * t.page)::BIGINT AS source_sum,
       sum(CASE WHEN t.kind = 'source' THEN p.width WHEN t.kind = 'page' THEN f.width END) AS width_sum, sum(CASE WHEN t.kind = 'source' THEN p.height WHEN t.kind = 'page' THEN f.height END) AS height_sum
FROM traced t LEFT JOIN uses u ON u.packet_id = t.packet_id AND u.pos = t.pos AND t.band = 1 LEFT JOIN part_pages p ON p.path = t.path AND p.page = t.source_page
LEFT JOIN within w ON w.packet_id = t.packet_id AND w.page = t.page JOIN fx2 f ON f.packet_id = t.packet_id AND f.pos = t.pos GROUP BY ALL"""))
def page_trace(spark, sf_dir):
    """The wide trace table with two levels of sections, digested per part and section."""
    parts, split = selected_parts(spark, sf_dir)
    labelled = layout.label_pages(parts, split=split)
    sizes = fx.part_pages(spark, sf_dir)
    same = ranges.page_runs(sizes.select("path", "page", F.col("width").alias("source_w"), F.col("height").alias("source_h"), F.col("width").alias("output_w"), F.col("height").alias("output_h")), ["path"], False)
    runs = same.select("path", "first", "last", F.col("source_w").alias("width"), F.col("source_h").alias("height"))
    own = labelled.filter("band = 1").withColumn("_i", F.col("pos") - 1)
    section = lambda depth, letter, size: F.struct(F.lit(depth).alias("depth"), F.concat(F.lit(f"{letter}/"), F.expr(f"cast(_i div {size} as string)")).alias("section"))
    outer, inner = F.array(section(0, "a", 4)), F.array(section(1, "b", 2))
    held = own.select("packet_id", F.explode(F.when(F.expr("_i div 2 % 2 = 0"), F.concat(outer, inner)).otherwise(outer)).alias("s"), "first_page", "last_page")
    spans = held.groupBy("packet_id", "s.depth", "s.section").agg(F.min("first_page").alias("first_page"), F.max("last_page").alias("last_page"))
    used = scan(labelled, ["packet_id", "path"], ["pos", "band"], [RunningSum("_use", F.when(F.col("kind") == "source", 1).otherwise(0))], split)
    carried = used.withColumn("occurrence", F.when(F.col("kind") == "source", F.col("_use")).cast("bigint"))
    columns = [*PART, "kind", "path", "pages", "ranges", "first_page", "last_page", "label_start", "occurrence", "width", "height"]
    tasks = task_count(spark, fx.table(spark, sf_dir, "lineitem").count())
    pages = layout.page_trace(carried.select(*columns), runs, spans, 2, split, tasks)
    return pages.groupBy(*PART, "kind", "occurrence", "section").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("output_page").alias("page_sum"), F.sum(F.col("source_page") * F.col("output_page")).alias("source_sum"),
        F.sum("width").alias("width_sum"), F.sum("height").alias("height_sum"))


@query("part_at", statement(fx.FX2, fx.FX2_FOLD, recursive=True, body="""
SELECT packet_id, pos, kind, first_page, last_page FROM parts WHERE first_page <= 10 AND last_page >= 10"""))
def part_at(spark, sf_dir):
    """The part that covers output page 10 of every packet."""
    parts, _ = placed_parts(spark, sf_dir)
    hit = parts.filter((F.col("first_page") <= 10) & (F.col("last_page") >= 10))
    return hit.select("packet_id", "pos", "kind", "first_page", "last_page")
