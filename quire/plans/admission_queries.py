"""Admission queries: items with defects that follow from the given columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import limits
from quire.functions.rules import language_ok, parse_tolerance
from quire.operators import admission, names
from quire.plans import fixtures as fx
from quire.plans.registry import query, statement


def authored_items(spark, sf_dir):
    """Order lines as authored items; sizes, counts, titles and ranges go wrong for some."""
    items, split = fx.order_items(spark, sf_dir)
    group = (F.col("kind") == "source") & (F.col("l_suppkey") % 7 == 0)
    kind = F.when(group, "group").when((F.col("kind") == "page") & (F.col("l_suppkey") % 29 == 0), "contents").otherwise(F.col("kind"))
    source, page = kind == "source", kind == "page"
    quantity = F.col("l_quantity").cast("bigint")
    title = F.when(F.col("l_partkey") % 5 == 0, F.lit(" \t")).when(F.col("l_partkey") % 5 == 1, F.lit("Two\nlines")).when(
        F.col("l_partkey") % 5 == 2, F.lit(None).cast("string")).otherwise(F.concat(F.lit("Part "), F.col("l_partkey").cast("string")))
    turned = F.array(F.struct(F.col("source_pages").alias("first"), F.lit(1).cast("bigint").alias("last")))
    rows = items.select(
        "packet_id", "pos", "ref", kind.alias("kind"), "line", "l_suppkey", "l_partkey",
        F.when(source, F.when(F.col("l_partkey") % 19 == 0, "").otherwise(F.coalesce("path", F.lit("x")))).alias("path"),
        F.when(source, F.when((F.col("line") == 7) & (F.col("source_pages") > 1), turned).otherwise(F.col("ranges"))).alias("ranges"),
        F.when(page, F.when(quantity == 50, 100001).otherwise(quantity - 3)).alias("count"),
        F.when(kind.isin("group", "contents"), title).alias("title"),
        F.when(page, F.when(F.col("source_pages") == 50, 14500.0).otherwise(F.col("width"))).alias("width"),
        F.when(page, F.col("height")).alias("height"),
        F.when(group & (F.col("line") == 2), "even").when(group & (F.col("line") == 3), "odd").alias("start_on"),
        F.lit(None).cast("string").alias("dir"), F.lit(None).cast("boolean").alias("numbering"),
        (group & (F.col("line") % 2 == 1)).alias("divider"),
        F.when(group & (F.col("line") == 5), "own text").alias("divider_text"),
        F.when(page, F.repeat(F.lit("é"), quantity.cast("int"))).alias("text"),
    )
    return rows, split


AUTHORED = """typed AS (
  SELECT *, CASE WHEN kind = 'source' AND l_suppkey % 7 = 0 THEN 'group' WHEN kind = 'page' AND l_suppkey % 29 = 0 THEN 'contents' ELSE kind END AS k FROM fx2),
authored AS MATERIALIZED (
  SELECT packet_id, pos, ref, k AS kind, line, l_suppkey, l_partkey,
    CASE WHEN k = 'source' THEN CASE WHEN l_partkey % 19 = 0 THEN '' ELSE path END END AS path,
    CASE WHEN k = 'source' THEN CASE WHEN line = 7 AND source_pages > 1 THEN [{'first': source_pages, 'last': 1::BIGINT}] ELSE ranges END END AS ranges,
    CASE WHEN k = 'page' THEN CASE WHEN trunc(l_quantity) = 50 THEN 100001 ELSE trunc(l_quantity)::BIGINT - 3 END END AS cnt,
    CASE WHEN k IN ('group', 'contents') THEN CASE l_partkey % 5 WHEN 0 THEN 'blank' WHEN 1 THEN 'lines' WHEN 2 THEN NULL ELSE 'Part ' || l_partkey END END AS title,
    CASE WHEN k IN ('group', 'contents') THEN CASE l_partkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 9 WHEN 2 THEN 0 ELSE 5 + length(l_partkey::VARCHAR) END ELSE 0 END AS title_bytes,
    CASE WHEN k = 'page' THEN CASE WHEN source_pages = 50 THEN 14500 ELSE width END END AS width,
    CASE WHEN k = 'page' THEN height END AS height,
    CASE WHEN k = 'group' AND line = 2 THEN 'even' WHEN k = 'group' AND line = 3 THEN 'odd' END AS start_on,
    k = 'group' AND line % 2 = 1 AS divider, k = 'group' AND line = 5 AS has_text,
    CASE WHEN k = 'page' THEN 2 * trunc(l_quantity)::BIGINT ELSE 0 END AS text_bytes
  FROM typed),
broken AS MATERIALIZED (
  SELECT packet_id, ref, 'plan_item_shape' AS code, 'shape' AS rule FROM authored WHERE (kind = 'group' AND title IS NULL AND start_on IS NULL) OR (divider AND title IS NULL)
  UNION ALL SELECT packet_id, ref, 'path_invalid', 'path' FROM authored WHERE path = ''
  UNION ALL SELECT packet_id, ref, 'plan_value', 'count' FROM authored WHERE cnt < 1
  UNION ALL SELECT packet_id, ref, 'plan_limit', 'count_limit' FROM authored WHERE cnt > 100000
  UNION ALL SELECT packet_id, ref, 'plan_value', 'ranges' FROM authored WHERE ranges[1].last < ranges[1].first
  UNION ALL SELECT packet_id, ref, 'plan_value', 'title' FROM authored WHERE title IN ('blank', 'lines')
  UNION ALL SELECT packet_id, ref, 'plan_value', 'size' FROM authored WHERE width > 14400 OR (width IS NULL) <> (height IS NULL)
  UNION ALL SELECT packet_id, ref, 'plan_value', 'divider_text' FROM authored WHERE divider AND has_text
  UNION ALL SELECT packet_id, ref, 'plan_value', 'start_on' FROM authored WHERE start_on = 'even')"""


def authored_packets(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders")
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda value: value.cast("string")
    return orders.select(
        key.alias("packet_id"), F.when(key % 31 == 0, F.lit("bad\x07bell")).otherwise(F.col("o_orderpriority")).alias("title"),
        F.lit(None).cast("string").alias("author"), F.lit(None).cast("string").alias("subject"),
        F.when(key % 4 == 0, "en-GB").when(key % 4 == 1, F.concat(F.lit("de-1996-"), text(1990 + customer % 10))).when(
            key % 4 == 2, F.concat(F.lit("x"), text(key % 3))).alias("language"),
        F.when(key % 41 == 0, F.lit(-1)).otherwise(F.unix_timestamp("o_orderdate")).cast("bigint").alias("timestamp"),
        F.when(F.col("o_orderstatus") == "P", "drop").otherwise("preserve").alias("structure"),
        F.when(key % 9 == 0, "roman").otherwise("physical").alias("number_mode"),
        (customer % 6).alias("number_start"),
        F.when(customer % 10 == 0, F.array(F.lit("source"), F.lit("source"))).when(customer % 10 == 1, F.array(F.lit("padding"))).alias("number_kinds"),
        F.when(key % 2 == 0, "bottom-center").alias("number_position"),
    )


PACKETS = """packet_faults AS (
  SELECT o_orderkey AS packet_id, 'metadata' AS rule FROM orders WHERE o_orderkey % 31 = 0
  UNION ALL SELECT o_orderkey, 'language' FROM orders WHERE (o_orderkey % 4 = 1 AND o_custkey % 10 = 6) OR o_orderkey % 4 = 2
  UNION ALL SELECT o_orderkey, 'timestamp' FROM orders WHERE o_orderkey % 41 = 0
  UNION ALL SELECT o_orderkey, 'structure' FROM orders WHERE o_orderstatus = 'P'
  UNION ALL SELECT o_orderkey, 'number_mode' FROM orders WHERE o_orderkey % 9 = 0
  UNION ALL SELECT o_orderkey, 'number_start' FROM orders WHERE o_custkey % 6 = 0
  UNION ALL SELECT o_orderkey, 'number_kinds' FROM orders WHERE o_custkey % 10 < 2
  UNION ALL SELECT packet_id, 'contents_once' FROM authored WHERE kind = 'contents' GROUP BY packet_id HAVING count(*) > 1
  UNION ALL SELECT packet_id, 'contents_sections' FROM authored GROUP BY packet_id
    HAVING bool_or(kind = 'contents') AND NOT bool_or(kind = 'group' AND title IS NOT NULL))"""


@query("admit_items", statement(fx.FX2, AUTHORED, PACKETS, body="""
SELECT packet_id, ref, code, rule FROM broken UNION ALL SELECT packet_id, NULL, 'plan_value', rule FROM packet_faults"""))
def admit_items(spark, sf_dir):
    items, _ = authored_items(spark, sf_dir)
    _, findings = admission.admit_items(items, authored_packets(spark, sf_dir))
    return findings


SHAPES = """shaped AS MATERIALIZED (
  SELECT packet_id, ref, l_partkey % 12 AS d, CASE WHEN kind = 'source' AND l_suppkey % 7 = 0 THEN 'group' WHEN kind = 'page' AND l_suppkey % 5 = 0 THEN 'contents' ELSE kind END AS k FROM fx2),
faults AS (
  SELECT packet_id, ref, CASE
    WHEN k IN ('source', 'page') AND d IN (0, 1, 2, 3) OR k = 'source' AND d = 4 OR k = 'contents' AND d IN (1, 2, 3, 4) THEN ['plan_item_shape', 'shape']
    WHEN k = 'page' AND d IN (5, 6) THEN ['plan_value', 'text'] WHEN k = 'group' AND d = 5 THEN ['path_invalid', 'dir'] END AS f FROM shaped)"""


@query("admit_shapes", statement(fx.FX2, SHAPES, body="SELECT packet_id, ref, f[1] AS code, f[2] AS rule FROM faults WHERE f IS NOT NULL"))
def admit_shapes(spark, sf_dir):
    """Items that have what only other kinds have, directories with NUL, and page texts with NUL or of 10,001 characters."""
    items, _ = fx.order_items(spark, sf_dir)
    d = F.col("l_partkey") % 12
    kind = F.when((F.col("kind") == "source") & (F.col("l_suppkey") % 7 == 0), "group").when((F.col("kind") == "page") & (F.col("l_suppkey") % 5 == 0), "contents").otherwise(F.col("kind"))
    rows = items.select("packet_id", "ref", kind.alias("kind"), d.alias("d"), F.coalesce("path", F.lit("x")).alias("_path"))
    page, group = F.col("kind") == "page", F.col("kind") == "group"
    text = F.when(page, F.when(F.col("d") == 5, F.lit("a\x00b")).when(F.col("d") == 6, F.repeat(F.lit("é"), 10001)).when(F.col("d") == 7, F.repeat(F.lit("é"), 10000))).when(F.col("d") == 4, "text")
    shaped = rows.select(
        "packet_id", "ref", "kind", F.when(F.col("kind") == "source", F.col("_path")).alias("path"), F.lit(None).cast("array<struct<first:bigint,last:bigint>>").alias("ranges"),
        F.lit(None).cast("bigint").alias("count"), F.lit(None).cast("double").alias("width"), F.lit(None).cast("double").alias("height"),
        F.when(group | (F.col("d") == 0), F.lit("Title")).alias("title"), F.when(F.col("d") == 1, "odd").alias("start_on"), (F.col("d") == 2).alias("divider"),
        F.when(F.col("d") == 3, "sub").when(group & (F.col("d") == 5), F.lit("a\x00b")).alias("dir"), F.when(~group, text).alias("text"))
    return admission.admit_items(shaped)[1]


@query("admit_packets", """
SELECT o_orderkey AS packet_id, code, rule FROM orders, (VALUES ('path_invalid', 'paths'), ('plan_value', 'fitting'), ('plan_value', 'number_start'), ('plan_value', 'number_size'), ('plan_value', 'number_margin')) r(code, rule)
WHERE CASE rule WHEN 'paths' THEN o_orderkey % 11 IN (0, 1) WHEN 'fitting' THEN o_custkey % 13 IN (0, 1, 2, 4) WHEN 'number_start' THEN o_custkey % 7 = 0
  WHEN 'number_size' THEN o_orderkey % 17 IN (0, 1) ELSE o_orderkey % 19 IN (0, 1) END""")
def admit_packets(spark, sf_dir):
    """Output paths with NUL, fitting policies out of bounds or with one side, numbering past the limits."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    none = lambda kind: F.lit(None).cast(kind)
    packets = fx.table(spark, sf_dir, "orders").select(
        key.alias("packet_id"), *[none("string").alias(c) for c in ("title", "author", "subject", "language")], none("bigint").alias("timestamp"), none("string").alias("structure"),
        F.lit("physical").alias("number_mode"), none("array<string>").alias("number_kinds"), none("string").alias("number_position"),
        F.when(key % 11 == 0, F.lit("out\x00.pdf")).otherwise("out.pdf").alias("output"), F.when(key % 11 == 1, F.lit("\x00")).alias("dir"),
        F.when(customer % 13 == 0, 0.5).when(customer % 13 == 2, None).when(customer % 13 < 5, 595.0).alias("fit_width"), F.when(customer % 13 == 1, 14401.0).when(customer % 13 < 5, 842.0).alias("fit_height"),
        F.when(customer % 13 == 4, -0.25).when(customer % 13 == 3, 0.0).alias("fit_tolerance"),
        F.when(customer % 7 == 0, F.lit(0)).otherwise(F.lit(limits.MAX_PAGE_INDEX)).cast("bigint").alias("number_start"),
        F.when(key % 17 == 0, 0.5).when(key % 17 == 1, F.lit(float("nan"))).when(key % 17 == 2, 14400.0).alias("number_size"),
        F.when(key % 19 == 0, -1.0).when(key % 19 == 1, F.lit(float("nan"))).when(key % 19 == 2, 0.0).alias("number_margin"))
    items = packets.select("packet_id", F.lit("i").alias("ref"), F.lit("page").alias("kind"), *[none(t).alias(c) for c, t in (("path", "string"), ("ranges", "array<struct<first:bigint,last:bigint>>"), ("count", "bigint"), ("title", "string"), ("width", "double"), ("height", "double"))])
    return admission.admit_items(items, packets)[1].select("packet_id", "code", "rule")


@query("accepted_items", statement(fx.FX2, AUTHORED, body="""
SELECT packet_id, ref, kind FROM authored WHERE ref NOT IN (SELECT ref FROM broken)"""))
def accepted_items(spark, sf_dir):
    items, _ = authored_items(spark, sf_dir)
    ok, _ = admission.admit_items(items)
    return ok.select("packet_id", "ref", "kind")


@query("limit_breaches", statement(fx.FX2, AUTHORED, """totals AS (
  SELECT packet_id, pos, ref, count(*) OVER w AS items, sum(coalesce(len(ranges), 0)) OVER w AS pairs,
         sum(coalesce(cnt, 0) + CASE WHEN divider THEN 1 ELSE 0 END) OVER w AS generated, sum(title_bytes + text_bytes) OVER w AS bytes
  FROM authored WINDOW w AS (PARTITION BY packet_id ORDER BY pos)),
passed AS (
  SELECT packet_id, pos, ref, 'items' AS "limit" FROM totals WHERE items > 5
  UNION ALL SELECT packet_id, pos, ref, 'pairs' FROM totals WHERE pairs > 3
  UNION ALL SELECT packet_id, pos, ref, 'generated' FROM totals WHERE generated > 60
  UNION ALL SELECT packet_id, pos, ref, 'bytes' FROM totals WHERE bytes > 90)""", body="""
SELECT packet_id, "limit", arg_min(ref, pos) AS ref, min(pos) AS pos FROM passed GROUP BY packet_id, "limit\""""))
def limit_breaches(spark, sf_dir):
    """Limits scaled down so that ordinary orders pass them."""
    items, split = authored_items(spark, sf_dir)
    return admission.limit_breaches(items, {"items": 5, "pairs": 3, "generated": 60, "bytes": 90}, split)


@query("duplicate_refs", statement(fx.FX2, """refs AS (
  SELECT packet_id, 'line/' || line AS ref FROM fx2
  UNION ALL SELECT packet_id, 'line/' || line || '/divider' FROM fx2 WHERE odd)""", body="""
SELECT packet_id, ref, count(*) AS uses FROM refs GROUP BY packet_id, ref HAVING count(*) > 1"""))
def duplicate_refs(spark, sf_dir):
    """Line numbers used as identities repeat inside some orders."""
    items, _ = fx.order_items(spark, sf_dir)
    refs = items.select("packet_id", F.concat(F.lit("line/"), F.col("line").cast("string")).alias("ref"), F.col("odd").alias("divider"))
    return admission.duplicate_refs(refs)


SPELLED = """spelled AS (
  SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'A4' WHEN 1 THEN p_size * 5 || 'x' || p_size * 7 || 'mm' WHEN 2 THEN 'inherit'
    WHEN 3 THEN p_size || '.5x' || p_size || 'in' WHEN 4 THEN p_size || ' by ' || p_size ELSE '.' || p_size || 'x' || p_size * 300 END AS spelling
  FROM part)"""


@query("normalise_sizes", statement(SPELLED, """taken AS (
  SELECT *, CASE WHEN spelling = 'A4' THEN 75600.0::DOUBLE / 127 WHEN spelling LIKE '%mm' THEN split_part(spelling, 'x', 1)::DOUBLE * (360.0::DOUBLE / 127)
     WHEN spelling LIKE '%in' THEN split_part(spelling, 'x', 1)::DOUBLE * 72 WHEN spelling LIKE '.%' THEN split_part(spelling, 'x', 1)::DOUBLE END AS width,
     CASE WHEN spelling = 'A4' THEN 106920.0::DOUBLE / 127 WHEN spelling LIKE '%mm' THEN replace(split_part(spelling, 'x', 2), 'mm', '')::DOUBLE * (360.0::DOUBLE / 127)
     WHEN spelling LIKE '%in' THEN replace(split_part(spelling, 'x', 2), 'in', '')::DOUBLE * 72 WHEN spelling LIKE '.%' THEN split_part(spelling, 'x', 2)::DOUBLE END AS height
  FROM (SELECT p_partkey, CASE WHEN spelling = 'inherit' THEN NULL ELSE spelling END AS spelling FROM spelled)),
judged AS (
  SELECT *, CASE WHEN p_partkey % 6 = 4 THEN 'size_grammar' WHEN width < 1 OR height < 1 OR width > 14400 OR height > 14400 THEN 'size_range' END AS reject FROM taken)""", body="""
SELECT p_partkey, CASE WHEN reject IS NULL THEN round(width, 6) END AS width, CASE WHEN reject IS NULL THEN round(height, 6) END AS height, reject FROM judged"""))
def normalise_sizes(spark, sf_dir):
    """Page sizes spelled six ways, from the part table."""
    part = fx.table(spark, sf_dir, "part")
    number = lambda c: c.cast("string")
    size, kind = F.col("p_size"), F.col("p_partkey") % 6
    spelling = (
        F.when(kind == 0, "A4").when(kind == 1, F.concat(number(size * 5), F.lit("x"), number(size * 7), F.lit("mm"))).when(kind == 2, "inherit")
        .when(kind == 3, F.concat(number(size), F.lit(".5x"), number(size), F.lit("in"))).when(kind == 4, F.concat(number(size), F.lit(" by "), number(size)))
        .otherwise(F.concat(F.lit("."), number(size), F.lit("x"), number(size * 300)))
    )
    accepted, rejected = admission.normalise_sizes(part.select("p_partkey", spelling.alias("spelling")), "spelling")
    both = accepted.withColumn("reject", F.lit(None).cast("string")).unionByName(rejected)
    return both.select("p_partkey", F.round("width", 6).alias("width"), F.round("height", 6).alias("height"), "reject")


@query("fit_tolerances", statement(body="""SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN NULL ELSE round(p_size * CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 360.0::DOUBLE / 127 WHEN 2 THEN 3600.0::DOUBLE / 127 ELSE 72 END, 6) END AS points
FROM part""").replace("WITH \n", ""))
def fit_tolerances(spark, sf_dir):
    """Tolerances in every unit; a negative one is refused."""
    part = fx.table(spark, sf_dir, "part")
    unit = F.element_at(F.array(*[F.lit(u) for u in ("pt", "mm", "cm", "in", "pt")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    text = F.concat(F.when(F.col("p_partkey") % 5 == 4, "-").otherwise(""), F.col("p_size").cast("string"), unit)
    return part.select("p_partkey", F.round(parse_tolerance(text), 6).alias("points"))


@query("language_tags", statement(body="""SELECT doc_id, lang || '-' || CASE doc_id % 6 WHEN 0 THEN 'Latn-001' WHEN 1 THEN 'variant' || doc_id % 3 || '-variant1' WHEN 2 THEN 'a-b-c'
   WHEN 3 THEN 'u-co-u-nu' WHEN 4 THEN 'x-a-b-a' ELSE 'toolongsubtag' END AS tag,
   doc_id % 6 IN (0, 4) OR (doc_id % 6 = 1 AND doc_id % 3 <> 1) AS valid FROM documents""").replace("WITH \n", ""))
def language_tags(spark, sf_dir):
    """Document languages with good and bad subtags."""
    docs = fx.table(spark, sf_dir, "documents")
    kind = F.col("doc_id") % 6
    rest = (
        F.when(kind == 0, "Latn-001").when(kind == 1, F.concat(F.lit("variant"), (F.col("doc_id") % 3).cast("string"), F.lit("-variant1")))
        .when(kind == 2, "a-b-c").when(kind == 3, "u-co-u-nu").when(kind == 4, "x-a-b-a").otherwise("toolongsubtag")
    )
    tagged = docs.select("doc_id", F.concat_ws("-", "lang", rest).alias("tag"))
    return tagged.withColumn("valid", language_ok(F.col("tag")))


CHARACTERS = r"""chars AS (
  SELECT {key}, (i - 1)::BIGINT AS p, c FROM (
    SELECT {key}, string_split(txt, '') AS cs FROM (SELECT {key}, replace(replace({text}, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS txt FROM {table})),
    unnest(cs) WITH ORDINALITY AS t(c, i)),
judged AS (
  SELECT {key}, p, CASE WHEN c = chr(10) THEN NULL WHEN c = chr(9) THEN 'tab' WHEN regexp_full_match(c, '\p{{Cc}}') THEN 'control'
    WHEN unicode(c) IN (8232, 8233) THEN 'separator' WHEN regexp_full_match(c, '\p{{Cf}}') THEN 'format'
    WHEN NOT regexp_full_match(c, '[\p{{Latin}}\p{{Greek}}\p{{Cyrillic}}\p{{Common}}\p{{Inherited}}]') THEN 'script' END AS reason
  FROM chars),
islands AS (
  SELECT *, p - row_number() OVER (PARTITION BY {key}, reason ORDER BY p) AS g FROM judged WHERE reason IS NOT NULL),
runs AS (
  SELECT {key}, min(p) AS "offset", count(*) AS run, reason FROM islands GROUP BY {key}, reason, g),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY "offset") AS n FROM runs)"""


@query("text_problem_runs", statement(CHARACTERS.format(key="doc_id", text="text || CASE WHEN doc_id % 4 = 0 THEN chr(9) || chr(9) || chr(8203) || chr(7) || chr(1488) || chr(1489) || chr(13) || chr(10) || chr(8232) ELSE '' END", table="documents"), body="""
SELECT doc_id, "offset", run, reason FROM ranked"""))
def text_problem_runs(spark, sf_dir):
    """Whole document texts, a quarter of which get a tail of unsupported characters."""
    docs = fx.table(spark, sf_dir, "documents")
    tail = F.when(F.col("doc_id") % 4 == 0, "\t\t\u200b\x07\u05d0\u05d1\r\n\u2028").otherwise("")
    return admission.text_problem_runs(docs.select("doc_id", F.concat("text", tail).alias("text")))


@query("path_conflicts", statement("""roles AS (
  SELECT page_id AS packet_id, 'output' AS role, regexp_extract(url, '^([a-z]+://[^/]+)', 1) AS path FROM pages WHERE page_id % 3 = 0
  UNION ALL SELECT page_id, 'report', upper(regexp_extract(url, '^([a-z]+://[^/]+)', 1)) FROM pages WHERE page_id % 3 = 1
  UNION ALL SELECT page_id, 'input', regexp_extract(url, '^([a-z]+://[^/]+)', 1) || '/' || page_id % 2 FROM pages WHERE page_id % 3 = 2
  UNION ALL SELECT page_id, 'output', regexp_extract(url, '^([a-z]+://[^/]+)', 1) || '/' || page_id % 4 FROM pages WHERE page_id % 5 = 2
  UNION ALL SELECT page_id + 100000000, CASE page_id % 3 WHEN 0 THEN 'output' WHEN 1 THEN 'input' ELSE 'report' END, CASE WHEN page_id % 2 = 0 THEN upper(url) ELSE url END FROM pages
  UNION ALL SELECT page_id + 200000000, 'output', url FROM pages WHERE page_id % 7 = 0),
keyed AS (SELECT *, lower(regexp_replace(path, '/+$', '')) AS key FROM roles),
grouped AS (
  SELECT key, count(*) FILTER (role <> 'input') AS writers, count(*) FILTER (role = 'input') AS readers,
         arg_min(packet_id || role || path, packet_id * 10 + CASE role WHEN 'output' THEN 1 ELSE 2 END) FILTER (role <> 'input') AS first_writer
  FROM keyed GROUP BY key)""", body="""
SELECT packet_id, role, path, k.key, CASE WHEN role = 'output' AND readers > 0 THEN 'output_is_input' WHEN role = 'report' AND readers > 0 THEN 'report_is_input'
       WHEN role = 'report' THEN 'report_is_output' ELSE 'output_exists' END AS code
FROM keyed k JOIN grouped g ON g.key = k.key
WHERE role <> 'input' AND (readers > 0 OR (writers > 1 AND packet_id || role || path <> first_writer))"""))
def path_conflicts(spark, sf_dir):
    """Hosts and whole urls of pages as output, report and input paths in different spellings."""
    pages = fx.table(spark, sf_dir, "pages")
    host, key = F.regexp_extract("url", r"^([a-z]+://[^/]+)", 1), F.col("page_id")
    pick = lambda rows, role, path: rows.select(key.alias("packet_id"), F.lit(role).alias("role"), path.alias("path"))
    below = lambda n: F.concat(host, F.lit("/"), (key % n).cast("string"))
    roles = (
        pick(pages.filter(key % 3 == 0), "output", host).unionByName(pick(pages.filter(key % 3 == 1), "report", F.upper(host)))
        .unionByName(pick(pages.filter(key % 3 == 2), "input", below(2))).unionByName(pick(pages.filter(key % 5 == 2), "output", below(4)))
    )
    url, third = F.col("url"), key % 3
    spelled = pages.select(
        (key + 100000000).alias("packet_id"), F.when(third == 0, "output").when(third == 1, "input").otherwise("report").alias("role"), F.when(key % 2 == 0, F.upper(url)).otherwise(url).alias("path"))
    again = pages.filter(key % 7 == 0).select((key + 200000000).alias("packet_id"), F.lit("output").alias("role"), url.alias("path"))
    return names.path_conflicts(roles.unionByName(spelled).unionByName(again)).drop("owner_path")
