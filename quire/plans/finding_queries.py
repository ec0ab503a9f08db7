"""Finding queries over events, and section reports over conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import findings as fd
from quire.operators import layout
from quire.operators.scan import CarryLast, scan
from quire.plans import fixtures as fx
from quire.plans.registry import query, statement

PREFIXED = "octet_length(encode({0})) || ':' || {0}"
KEYED = """keyed AS (
  SELECT *, sha256(strlen(identity_kind) || ':' || identity_kind || strlen(phase) || ':' || phase || strlen(props) || ':' || props) AS finding_key,
         priority = 0 AND file IS NOT NULL AS mergeable
  FROM fx6)"""
MERGED = """merged AS MATERIALIZED (
  SELECT packet_id, min(seq) AS seq, code, min(priority) AS priority, file, finding_key, count(*) AS occurrences
  FROM keyed GROUP BY packet_id, code, file, finding_key, CASE WHEN mergeable THEN 0 ELSE seq + 1 END),
item_rows AS (
  SELECT packet_id, code, file, finding_key, CASE WHEN mergeable THEN 0 ELSE seq + 1 END AS own, seq, unnest(items) AS item, unnest(range(1, len(items) + 1)) AS at_pos FROM keyed),
first_seen AS (
  SELECT packet_id, code, file, finding_key, own, item, min(seq * 10 + at_pos) AS seen FROM item_rows GROUP BY ALL),
firsts AS (SELECT packet_id, code, file, finding_key, own, min(seq) AS seq FROM item_rows GROUP BY ALL),
merged_items AS MATERIALIZED (
  SELECT s.packet_id, f.seq, item, row_number() OVER (PARTITION BY s.packet_id, s.code, s.file, s.finding_key, s.own ORDER BY seen) AS ordinal
  FROM first_seen s JOIN firsts f ON s.packet_id = f.packet_id AND s.code = f.code AND s.file IS NOT DISTINCT FROM f.file
   AND s.finding_key = f.finding_key AND s.own = f.own)"""


@query("finding_key", statement(fx.FX6, KEYED, body="SELECT packet_id, seq, finding_key FROM keyed"))
def finding_key(spark, sf_dir):
    return fd.finding_key(fx.event_findings(spark, sf_dir)).select("packet_id", "seq", "finding_key")


@query("merge_findings", statement(fx.FX6, KEYED, MERGED, body="SELECT packet_id, seq, code, file, finding_key, occurrences FROM merged"))
def merge_findings(spark, sf_dir):
    merged, _ = fd.merge_findings(fx.event_findings(spark, sf_dir), fx.event_split(spark, sf_dir))
    return merged.select("packet_id", "seq", "code", "file", "finding_key", "occurrences")


@query("merge_finding_items", statement(fx.FX6, KEYED, MERGED, body="SELECT packet_id, seq, ordinal, item FROM merged_items"))
def merge_finding_items(spark, sf_dir):
    _, items = fd.merge_findings(fx.event_findings(spark, sf_dir), fx.event_split(spark, sf_dir))
    return items


@query("distinct_in_order", statement(body="""SELECT doc_id, len(words) AS words, array_to_string(list_transform(list_sort(list_transform(
  list_distinct(words), lambda w: {'i': list_position(words, w), 'w': w})), lambda s: s.w), ' ') AS ordered
FROM (SELECT doc_id, string_split(text, ' ') AS words FROM documents)""").replace("WITH \n", ""))
def distinct_in_order(spark, sf_dir):
    """Words of every document in first-seen order."""
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("words"))
    counted = docs.withColumn("n", F.size("words").cast("bigint"))
    return fd.distinct_in_order(counted, "words").select("doc_id", F.col("n").alias("words"), F.array_join("words", " ").alias("ordered"))


@query("rank_findings", statement(fx.FX6, body="""
SELECT packet_id, seq, code, row_number() OVER (PARTITION BY packet_id ORDER BY priority DESC, seq) AS rank FROM fx6"""))
def rank_findings(spark, sf_dir):
    return fd.rank_findings(fx.event_findings(spark, sf_dir), fx.event_split(spark, sf_dir)).select("packet_id", "seq", "code", "rank")


def sessions(spark, sf_dir):
    """Findings grouped into packets of eight consecutive events, some of which have no errors."""
    rows = fx.event_findings(spark, sf_dir)
    return rows.withColumn("packet_id", F.expr("seq div 8"))


@query("packet_status", statement(fx.FX6, body="""
SELECT seq // 8 AS packet_id, CASE max(priority) WHEN 3 THEN 'interrupted' WHEN 2 THEN 'failed' WHEN 1 THEN 'invalid' ELSE 'ok' END AS status
FROM fx6 GROUP BY 1"""))
def packet_status(spark, sf_dir):
    rows = sessions(spark, sf_dir)
    return fd.packet_status(rows, rows)


@query("drop_failed", statement(fx.FX6, body="""
SELECT seq // 8 AS packet_id, seq, code FROM fx6 WHERE seq // 8 NOT IN (SELECT seq // 8 FROM fx6 WHERE priority > 0)"""))
def drop_failed(spark, sf_dir):
    rows = fd.with_codes(sessions(spark, sf_dir))
    return layout.drop_failed(rows, rows).select("packet_id", "seq", "code")


@query("first_fault", statement(fx.FX6, body="""
SELECT packet_id, arg_min(seq, (seq % 100) * 100000000 + seq) AS seq, arg_min(code, (seq % 100) * 100000000 + seq) AS code FROM fx6 WHERE priority > 0 GROUP BY packet_id"""))
def first_fault(spark, sf_dir):
    rows = fd.with_codes(fx.event_findings(spark, sf_dir)).filter(F.col("severity") == "error")
    return fd.first_fault(rows.withColumn("offset", F.col("seq") % 100)).select("packet_id", "seq", "code")


@query("cap_findings", statement(fx.FX6, KEYED, MERGED, body="""
SELECT m.packet_id, rank, m.seq, code, occurrences, array_to_string(list_sort(shown), ',') AS item_names,
       greatest(coalesce(n, 0) - 5, 0) AS items_omitted, total - least(total, 5) AS findings_omitted
FROM (SELECT *, row_number() OVER (PARTITION BY packet_id ORDER BY priority DESC, seq) AS rank, count(*) OVER (PARTITION BY packet_id) AS total FROM merged) m
LEFT JOIN (SELECT packet_id, seq, count(*) AS n, list(item) FILTER (ordinal <= 5) AS shown FROM merged_items GROUP BY ALL) i
  ON i.packet_id = m.packet_id AND i.seq = m.seq WHERE rank <= 5"""))
def cap_findings(spark, sf_dir):
    merged, items = fd.merge_findings(fx.event_findings(spark, sf_dir), fx.event_split(spark, sf_dir))
    capped = fd.cap_findings(merged, items, 5)
    return capped.select("packet_id", "rank", "seq", "code", "occurrences", F.array_join(F.array_sort("items"), ",").alias("item_names"), "items_omitted", "findings_omitted")


@query("findings_summary", statement(fx.FX6, body="""
SELECT code, CASE WHEN priority > 0 THEN 'error' ELSE 'warning' END AS severity,
       CASE priority WHEN 3 THEN 'interrupted' WHEN 2 THEN 'failed' WHEN 1 THEN 'invalid' END AS class, file,
       count(*) AS findings, count(DISTINCT packet_id) AS packets
FROM fx6 GROUP BY code, priority, file"""))
def findings_summary(spark, sf_dir):
    return fd.findings_summary(fx.event_findings(spark, sf_dir))


# --- conversations: sections, contents, previews ------------------------------------------

def sectioned_parts(spark, sf_dir):
    """Every turn is a part; a user turn opens a section on an odd page and owns what follows."""
    turns, split = fx.conversation_turns(spark, sf_dir)
    opened = scan(turns, ["packet_id"], ["pos"], [CarryLast("section", F.when(F.col("opens"), F.col("ref")), inclusive=True)], split)
    events = opened.withColumns({"odd": F.col("opens"), "kind": F.lit("source"), "section_path": F.array_compact(F.array("section"))})
    parts = layout.place_parts(layout.pad_odd_starts(events, split=split), split)
    headings = turns.filter("opens").select("packet_id", F.col("ref").alias("section"), "title", "pos", F.lit(0).alias("depth"))
    return parts, headings, split


SPANS4 = """spans4 AS MATERIALIZED (
  SELECT f.packet_id, f.section, min(f.first_page) AS first_page, max(f.last_page) AS last_page, min(f.first_page) AS target
  FROM fold4 f WHERE f.section IS NOT NULL GROUP BY ALL),
headed AS MATERIALIZED (SELECT s.*, i.title, i.pos FROM spans4 s JOIN fx4 i ON i.packet_id = s.packet_id AND i.ref = s.section)"""


@query("section_spans", statement(fx.FX4, fx.FX4_FOLD, SPANS4, recursive=True, body="""
SELECT packet_id, section, first_page, last_page, target FROM headed"""))
def section_spans(spark, sf_dir):
    parts, headings, _ = sectioned_parts(spark, sf_dir)
    return layout.section_spans(headings, parts).select("packet_id", "section", "first_page", "last_page", "target")


@query("contents_rows", statement(fx.FX4, fx.FX4_FOLD, SPANS4, recursive=True, body="""
SELECT h.packet_id, h.section, h.title, 0 AS indent, h.target,
       (3 + (SELECT coalesce(sum(last_page - first_page + 1), 0) FROM fold4 f WHERE f.packet_id = h.packet_id AND f.last_page < h.target))::BIGINT::VARCHAR AS label
FROM headed h"""))
def contents_rows(spark, sf_dir):
    """Contents lines of every conversation, numbered consecutively from 3."""
    parts, headings, split = sectioned_parts(spark, sf_dir)
    numbered = parts.withColumns({"mode": F.lit("consecutive"), "start": F.lit(3), "enabled": F.col("kind") != "padding"})
    labelled = layout.label_pages(numbered, split=split)
    rows = layout.contents_rows(layout.section_spans(headings, parts), labelled)
    return rows.select("packet_id", "section", "title", F.col("indent").cast("bigint").alias("indent"), "target", "label")


@query("paginate_rows", statement(fx.FX4, """filled(packet_id, pos, page, used) AS (
  SELECT packet_id, pos, 1::BIGINT, height + 6 FROM fx4 WHERE pos = 1
  UNION ALL
  SELECT i.packet_id, i.pos, CASE WHEN f.used + i.height <= 60 THEN f.page ELSE f.page + 1 END,
         CASE WHEN f.used + i.height <= 60 THEN f.used ELSE 0 END + i.height + 6
  FROM filled f JOIN fx4 i ON i.packet_id = f.packet_id AND i.pos = f.pos + 1)""", recursive=True, body="""
SELECT packet_id, pos, page FROM filled"""))
def paginate_rows(spark, sf_dir):
    turns, _ = fx.conversation_turns(spark, sf_dir)
    placed, _ = layout.paginate_rows(turns.select("packet_id", "pos", "height"), 60, 6)
    return placed.select("packet_id", "pos", "page")


@query("paginate_rejects", statement(fx.FX4, body="SELECT packet_id, pos, height FROM fx4 WHERE height > 25"))
def paginate_rejects(spark, sf_dir):
    """Rows taller than a page of 25 points."""
    turns, _ = fx.conversation_turns(spark, sf_dir)
    _, rejected = layout.paginate_rows(turns.select("packet_id", "pos", "height"), 25, 6)
    return rejected


@query("preview_rows", statement(fx.FX4, fx.FX4_FOLD, SPANS4, """allrows AS (
  SELECT packet_id, 0 AS b, 'section' AS row, pos, section AS ref, first_page, last_page FROM headed
  UNION ALL
  SELECT f.packet_id, 1, 'part', f.pos, i.ref, f.first_page, f.last_page FROM fold4 f JOIN fx4 i USING (packet_id, pos)
  UNION ALL
  SELECT f.packet_id, 1, 'part', f.pos, i.ref, f.first_page - 1, f.first_page - 1 FROM fold4 f JOIN fx4 i USING (packet_id, pos) WHERE f.pad = 1)""", recursive=True, body="""
SELECT packet_id, row, pos, ref, first_page, last_page, rank, greatest(total - 6, 0) AS omitted FROM (
  SELECT *, row_number() OVER (PARTITION BY packet_id ORDER BY b, pos, first_page) AS rank, count(*) OVER (PARTITION BY packet_id) AS total FROM allrows)
WHERE rank <= 6"""))
def preview_rows(spark, sf_dir):
    parts, headings, _ = sectioned_parts(spark, sf_dir)
    spans = layout.section_spans(headings, parts).withColumnRenamed("section", "ref")
    return fd.preview_rows(spans, parts, 6).withColumn("rank", F.col("rank").cast("bigint"))


@query("coverage_status", statement(fx.FX2, body="""
SELECT packet_id, CASE WHEN min(CASE WHEN packet_id % 7 = 0 THEN 'discard' ELSE 'preserve' END) = 'discard' OR NOT bool_or(l_partkey % 3 = 0) THEN 'none'
       WHEN bool_or(kind = 'source' AND l_partkey % 5 = 0) THEN 'partial' ELSE 'complete' END AS coverage
FROM fx2 GROUP BY packet_id"""))
def coverage_status(spark, sf_dir):
    items, _ = fx.order_items(spark, sf_dir)
    flagged = items.withColumns({
        "structure": F.when(F.col("packet_id") % 7 == 0, "discard").otherwise("preserve"),
        "covered": F.col("l_partkey") % 3 == 0, "uncovered": (F.col("kind") == "source") & (F.col("l_partkey") % 5 == 0),
    })
    return fd.coverage_status(flagged)
