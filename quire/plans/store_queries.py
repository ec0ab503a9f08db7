"""Queries that write and read stores: manifests, blobs, reports, published tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import findings, layout
from quire.operators.scan import scratch_path
from quire.plans import fixtures as fx
from quire.plans.finding_queries import SPANS4, paginate_rejects, sectioned_parts
from quire.plans.registry import query, statement
from quire.sources import blobs, manifests, reports


def manifest_lines(spark, sf_dir):
    """One nested manifest per document, written by Spark as JSON lines; some are malformed."""
    docs = fx.table(spark, sf_dir, "documents")
    key = F.col("doc_id")
    text = lambda c: c.cast("string")
    pages = lambda n: F.array(F.array(F.lit(1).cast("bigint"), n.cast("bigint")))
    source = lambda i: F.struct(F.concat(F.lit("doc/"), text(key + i)).alias("source"), pages(1 + F.expr("n_chars div 1800")).alias("pages"))
    leaves = F.transform(F.sequence(F.lit(0), (key % 4).cast("int")), source)
    inner = F.struct(F.col("lang").alias("title"), F.lit("odd").alias("start_on"), leaves.alias("items"))
    blank = F.struct(F.struct(F.lit("A4").alias("size")).alias("page"), (1 + key % 3).cast("bigint").alias("count"))
    outer = lambda i: F.struct(F.concat(F.lit("Part "), text(i)).alias("title"), F.array(inner).alias("items"))
    groups = F.transform(F.sequence(F.lit(1), (1 + key % 2).cast("int")), outer)
    body = F.concat(
        F.lit("{"), F.when(key % 41 == 0, '"colour":1,').otherwise(""),  # a foreign member comes first, so it is the first fault
        F.lit('"version":'), text(F.when(key % 37 == 0, 7).otherwise(8)), F.lit(',"output":"out/'), text(key), F.lit('.pdf"'), F.lit(',"items":['),
        F.array_join(F.concat(F.array(F.to_json(blank)), F.transform(groups, lambda g: F.to_json(g))), ","), F.lit("]}"),
    )
    line = F.concat(F.lit('{"packet_id":"'), text(key), F.lit('","manifest":'), body, F.when(key % 43 == 0, "").otherwise("}"))
    path = scratch_path(spark, "manifests")
    docs.select(line.alias("value")).write.text(path)
    return manifests.scan_manifests(spark, path, "lines")


MANIFESTS = """good AS (SELECT * FROM documents WHERE doc_id % 37 <> 0 AND doc_id % 41 <> 0 AND doc_id % 43 <> 0),
outer_groups AS (SELECT doc_id, lang, n_chars, unnest(range(1, 2 + doc_id % 2)) AS g FROM good),
leaves AS (SELECT doc_id, n_chars, g, unnest(range(0, doc_id % 4 + 1)) AS i FROM outer_groups)"""


@query("scan_manifests", statement(MANIFESTS, body="""
SELECT doc_id::VARCHAR AS packet_id, '/items/0' AS ref, '' AS parent_ref, 0 AS pos, 'page' AS kind, NULL AS path, NULL::BIGINT AS last, 1 + doc_id % 3 AS count, NULL AS title, NULL AS start_on FROM good
UNION ALL SELECT doc_id::VARCHAR, '/items/' || g, '', g, 'group', NULL, NULL, NULL, 'Part ' || g, NULL FROM outer_groups
UNION ALL SELECT doc_id::VARCHAR, '/items/' || g || '/items/0', '/items/' || g, 0, 'group', NULL, NULL, NULL, lang, 'odd' FROM outer_groups
UNION ALL SELECT doc_id::VARCHAR, '/items/' || g || '/items/0/items/' || i, '/items/' || g || '/items/0', i, 'source', 'doc/' || (doc_id + i), 1 + n_chars // 1800, NULL, NULL, NULL FROM leaves"""))
def scan_manifests(spark, sf_dir):
    items = manifest_lines(spark, sf_dir).items
    return items.select("packet_id", "ref", "parent_ref", "pos", "kind", "path", F.col("ranges")[0]["last"].alias("last"), "count", "title", "start_on")


@query("manifest_rejects", statement(body="""SELECT CASE WHEN doc_id % 43 = 0 THEN 'unknown' ELSE doc_id::VARCHAR END AS packet_id,
  CASE WHEN doc_id % 43 = 0 THEN 'plan_syntax' WHEN doc_id % 41 = 0 THEN 'plan_unknown_member' ELSE 'plan_version_unsupported' END AS code
FROM documents WHERE doc_id % 37 = 0 OR doc_id % 41 = 0 OR doc_id % 43 = 0""").replace("WITH \n", ""))
def manifest_rejects(spark, sf_dir):
    """Packets that are refused; a line that is no JSON has no readable identity."""
    rejects = manifest_lines(spark, sf_dir).rejects
    return rejects.select(F.when(F.length("packet_id") == 64, "unknown").otherwise(F.col("packet_id")).alias("packet_id"), "code")


#: Last items of manifests, each with the code that refuses it (null: accepted).
LAST_ITEMS = [
    ('{"source":"x","pages":[[1,2],[4,4]]}', None), ('{"source":"x","pages":[[1,null]]}', "plan_null"), ('{"source":"x","pages":[[1,2,3]]}', "plan_type"),
    ('{"source":"x","pages":[[1.0,2]]}', "plan_value"), ('{"source":"x","pages":[[1,2e0]]}', "plan_value"), ('{"source":"x","pages":[[1,9223372036854775808]]}', "plan_value"),
    ('{"source":"x","pages":[[1,2],[2,3]]}', "plan_value"), ('{"source":"x","source":"y"}', "plan_duplicate_member"), ('{"page":{},"count":100001}', "plan_limit"),
    ('{"page":{},"count":3.0}', "plan_value"), ('{"page":{"text":{"wrap":"anywhere"}}}', "plan_value"), ('{"page":{"text":{"wrap":true}}}', "plan_type"),
    ('{"page":{"text":{"width":0}}}', "plan_value"), ('{"page":{"text":{"font":{}}}}', "plan_type"), ('{"title":"A","divider":{"text":{"value":"B"}},"items":[{"source":"x"}]}', "plan_value"),
    ('{"source":""}', "path_invalid"), ('{"page":{"text":{"font":"default","x":"-5mm","color":"#abc"}}}', None), ('{"source":"x"}]} null [{', "plan_syntax"), ('{"contents":{}},{"contents":{}}', "plan_value"),
]


@query("manifest_faults", "SELECT doc_id::VARCHAR AS packet_id, c.code FROM documents JOIN (VALUES " + ", ".join(
    f"({k}, {code!r})" for k, (_, code) in enumerate(LAST_ITEMS) if code) + f") c(k, code) ON doc_id % {len(LAST_ITEMS)} = c.k")
def manifest_faults(spark, sf_dir):
    """One manifest per document: a source for each thousand characters, then an item that may be faulty."""
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    last = F.element_at(F.array(*[F.lit(text) for text, _ in LAST_ITEMS]), (F.col("doc_id") % len(LAST_ITEMS) + 1).cast("int"))
    sources = F.array_join(F.transform(F.sequence(F.lit(0), F.expr("n_chars div 1000").cast("int")), lambda i: F.concat(F.lit('{"source":"doc/'), i.cast("string"), F.lit('"},'))), "")
    texts = docs.select(F.col("doc_id").cast("string").alias("packet_id"), F.concat(F.lit('{"version":8,"items":['), sources, last, F.lit("]}")).alias("manifest"))
    return manifests.parse_manifests(texts).rejects.select("packet_id", "code")


@query("scan_blobs", statement(body="""SELECT 'page/' || page_id AS path, strlen(html) AS bytes, sha256(html) AS digest, contains(html, '<title>') AS recognised,
  CASE WHEN contains(html, '<title>') THEN strlen(split_part(html, '<title>', 1)) END AS header_at FROM pages
UNION ALL SELECT 'doc/' || doc_id, strlen(text), sha256(text), contains(text, '<title>'), CASE WHEN contains(text, '<title>') THEN strlen(split_part(text, '<title>', 1)) END FROM documents""").replace("WITH \n", ""))
def scan_blobs(spark, sf_dir):
    """Facts of raw pages and documents; a title element stands in for the file header."""
    named = lambda name, key, prefix, content: fx.table(spark, sf_dir, name).select(
        F.concat(F.lit(prefix), F.col(key).cast("string")).alias("path"), F.col(content).cast("binary").alias("content"))
    both = named("pages", "page_id", "page/", "html").unionByName(named("documents", "doc_id", "doc/", "text"))
    return blobs.blob_facts(both, F.col("content"), "<title>")


def turn_findings(spark, sf_dir):
    """Turns taller than a page of 25 points, as findings in the order of the turns."""
    turns, _ = fx.conversation_turns(spark, sf_dir)
    high = paginate_rejects(spark, sf_dir).select("packet_id", "pos")
    found = turns.select("packet_id", "pos", "ref").join(high, ["packet_id", "pos"], "left_semi")
    return findings.with_codes(found.select("packet_id", F.col("pos").alias("order"), F.lit("text_overflow").alias("code"), F.col("ref").alias("file"), F.array("ref").alias("items")))


def saved_reports(spark, sf_dir):
    """Reports of all conversations, written and read back."""
    parts, headings, split = sectioned_parts(spark, sf_dir)
    spans = layout.section_spans(headings, parts)
    labelled = layout.label_pages(parts.withColumns({"mode": F.lit("physical"), "start": F.lit(1), "enabled": F.col("kind") != "padding"}), split=split)
    found = turn_findings(spark, sf_dir)
    totals = layout.page_totals(parts)
    headers = totals.join(findings.packet_status(totals, found), "packet_id")
    rows = labelled.withColumns({"order": F.struct("pos", "band"), "item": F.col("ref")})
    titled = spans.withColumns({"order": F.col("pos"), "item": F.col("section"), "target_page": F.col("target")})
    path = scratch_path(spark, "reports")
    reports.write_reports(reports.report_records(headers, rows, titled, found), path)
    return reports.read_reports(spark, path)


@query("read_reports", statement(fx.FX4, fx.FX4_FOLD, """rows4 AS (
  SELECT packet_id, pos, 1 AS band, 'source' AS kind, first_page, last_page FROM fold4
  UNION ALL SELECT packet_id, pos, 0, 'padding', first_page - 1, first_page - 1 FROM fold4 WHERE pad = 1)""", recursive=True, body="""
SELECT packet_id::VARCHAR AS packet_id, row_number() OVER (PARTITION BY packet_id ORDER BY pos, band) AS place, kind, last_page - first_page + 1 AS pages,
       first_page, last_page, CASE WHEN kind = 'source' THEN first_page END AS label_start FROM rows4"""))
def read_reports(spark, sf_dir):
    parts = saved_reports(spark, sf_dir).parts
    return parts.select("packet_id", "place", "kind", "pages", "first_page", "last_page", "label_start")


@query("write_reports", statement(fx.FX4, fx.FX4_FOLD, SPANS4, recursive=True, body="""
SELECT packet_id::VARCHAR AS packet_id, row_number() OVER (PARTITION BY packet_id ORDER BY pos) AS place, section AS item, title, first_page, last_page, target AS target_page FROM headed"""))
def write_reports(spark, sf_dir):
    """The ordered sections of the written reports."""
    sections = saved_reports(spark, sf_dir).sections
    return sections.select("packet_id", "place", "item", "title", "first_page", "last_page", "target_page")


@query("publish", statement(fx.FX1_SNAPSHOTS, body="SELECT path, digest FROM fx1_after"))
def publish(spark, sf_dir):
    """The later shelf replaces an earlier published one, which a plain publish refuses."""
    before, after = fx.document_snapshots(spark, sf_dir)
    path = scratch_path(spark, "shelf")
    reports.publish(before, path, [sf_dir])
    try:
        reports.publish(after, path, [sf_dir])
        raise AssertionError("an existing target was replaced")
    except reports.PublishRefused:
        reports.publish(after, path, [sf_dir], overwrite=True)
    return spark.read.parquet(path).select("path", "digest")
