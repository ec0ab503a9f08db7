"""The given tables seen as packets: each view once as a DataFrame, once as a DuckDB CTE.

Views that number rows inside a packet return ``(frame, split)``: whether some packet is
too large for one task is measured once on the raw keys and handed to every operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.scan import exceeds_group_limit, spread, task_count, with_positions

#: Rows of ``part`` beyond which Spark joins them sorted.
SORTED_PARTS = 2_000_000
FIT_W, FIT_H, FIT_TOLERANCE = 525.0, 702.0, 1.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- documents as sources -------------------------------------------------------------

def document_sources(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("source").alias("packet_id"),
        "doc_id",
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"),
        F.sha2(F.col("text").cast("binary"), 256).alias("digest"),
        (1 + F.expr("n_chars div 1800")).alias("pages"),
        F.when(F.col("doc_id") % 11 == 0, "2.0").otherwise("1.7").alias("version"),
        (F.col("doc_id") % 7 == 0).alias("has_fields"),
        F.sha2(F.col("lang").cast("binary"), 256).alias("defaults_digest"),
        "lang",
    )


FX1 = """fx1 AS (
  SELECT source AS packet_id, doc_id, 'doc/' || doc_id AS path, sha256(text) AS digest,
         1 + n_chars // 1800 AS pages, CASE WHEN doc_id % 11 = 0 THEN '2.0' ELSE '1.7' END AS version,
         doc_id % 7 = 0 AS has_fields, sha256(lang) AS defaults_digest, lang
  FROM documents)"""


def document_snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The same shelf twice: some documents vanish, some appear, some change their text."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path")
    digest = F.sha2(F.col("text").cast("binary"), 256)
    changed = F.sha2(F.concat("lang", "text").cast("binary"), 256)
    before = docs.filter(F.col("doc_id") % 10 != 0).select(path, digest.alias("digest"))
    after = docs.filter(F.col("doc_id") % 13 != 0).select(
        path, F.when(F.col("doc_id") % 17 == 0, changed).otherwise(digest).alias("digest")
    )
    return before, after


FX1_SNAPSHOTS = """fx1_before AS (
  SELECT 'doc/' || doc_id AS path, sha256(text) AS digest FROM documents WHERE doc_id % 10 <> 0),
fx1_after AS (
  SELECT 'doc/' || doc_id AS path,
         CASE WHEN doc_id % 17 = 0 THEN sha256(lang || text) ELSE sha256(text) END AS digest
  FROM documents WHERE doc_id % 13 <> 0)"""


# --- orders as packets ----------------------------------------------------------------

ITEM_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"]


def order_items(spark, sf_dir) -> tuple[DataFrame, bool]:
    lines = table(spark, sf_dir, "lineitem")
    split = exceeds_group_limit(lines, ["l_orderkey"], table=True)
    tasks = task_count(spark, lines.count())
    # groups beyond the limit are sorted by range instead, as dealing by key would gather them
    placed = with_positions(lines if split else spread(lines, tasks, "l_orderkey"), ["l_orderkey"], ITEM_ORDER, "pos", split)
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    many = parts.count() > SORTED_PARTS
    joined = placed.join(orders, placed.l_orderkey == orders.o_orderkey).join(
        spread(parts, tasks if many else None, "p_partkey"), placed.l_partkey == parts.p_partkey
    )
    if many and not split:  # a sorted join has dealt the rows by part
        joined = spread(joined, tasks, "l_orderkey")
    is_page = F.col("l_returnflag") == "A"
    size = F.col("p_size").cast("bigint")
    pages = F.when(is_page, 1 + F.col("l_quantity").cast("bigint") % 3).otherwise(size)
    span = lambda first, last: F.struct(first.cast("bigint").alias("first"), last.cast("bigint").alias("last"))
    half = F.expr("cast(p_size as bigint) div 2")
    ranges = F.when(
        ~is_page & (F.col("p_size") >= 5),
        F.when(
            F.col("l_linenumber") % 2 == 0,
            F.array(span(F.lit(1), half), span(half + 1, size - 1)),
        ).otherwise(F.array(span(F.lit(1), F.lit(1)), span(F.lit(3), size))),
    )
    inherits = is_page & (F.col("l_linenumber") % 2 == 0)
    items = joined.select(
        F.col("l_orderkey").alias("packet_id"),
        "pos",
        F.concat_ws("/", F.lit("items"), F.col("l_orderkey"), F.col("pos")).alias("ref"),
        F.when(is_page, "page").otherwise("source").alias("kind"),
        F.when(~is_page, F.concat(F.lit("part/"), F.col("l_partkey").cast("string"))).alias("path"),
        pages.alias("pages"),
        (F.col("l_linestatus") == "O").alias("odd"),
        F.when(F.col("l_suppkey") % 3 == 0, False).when(F.col("l_suppkey") % 3 == 1, True).alias("numbering"),
        ranges.alias("ranges"),
        F.when(~inherits, (500 + F.col("p_size")).cast("double")).alias("width"),
        F.when(~inherits, (700 + F.col("p_size") % 5).cast("double")).alias("height"),
        F.when(F.col("o_orderstatus") == "F", "physical").when(F.col("o_orderstatus") == "O", "consecutive").alias("mode"),
        F.when(F.col("o_orderstatus") != "P", 1 + F.col("o_custkey") % 5).alias("start"),
        F.when(~is_page, F.col("p_brand")).alias("name"),
        (~is_page & (F.col("p_size") % 4 == 0)).alias("has_fields"),
        F.sha2(F.col("p_type").cast("binary"), 256).alias("defaults_digest"),
        F.col("p_size").cast("bigint").alias("source_pages"),
        "l_partkey", "l_suppkey", F.col("l_linenumber").cast("bigint").alias("line"), "l_quantity",
    )
    return items, split


FX2 = """fx2 AS MATERIALIZED (
  SELECT l_orderkey AS packet_id, pos, 'items/' || l_orderkey || '/' || pos AS ref,
         CASE WHEN l_returnflag = 'A' THEN 'page' ELSE 'source' END AS kind,
         CASE WHEN l_returnflag <> 'A' THEN 'part/' || l_partkey END AS path,
         CASE WHEN l_returnflag = 'A' THEN 1 + CAST(trunc(l_quantity) AS BIGINT) % 3 ELSE CAST(p_size AS BIGINT) END AS pages,
         l_linestatus = 'O' AS odd,
         CASE l_suppkey % 3 WHEN 0 THEN false WHEN 1 THEN true END AS numbering,
         CASE WHEN l_returnflag <> 'A' AND p_size >= 5 THEN
           CASE WHEN l_linenumber % 2 = 0
                THEN [{'first': 1::BIGINT, 'last': (p_size // 2)::BIGINT}, {'first': (p_size // 2 + 1)::BIGINT, 'last': (p_size - 1)::BIGINT}]
                ELSE [{'first': 1::BIGINT, 'last': 1::BIGINT}, {'first': 3::BIGINT, 'last': p_size::BIGINT}] END END AS ranges,
         CASE WHEN NOT (l_returnflag = 'A' AND l_linenumber % 2 = 0) THEN (500 + p_size)::DOUBLE END AS width,
         CASE WHEN NOT (l_returnflag = 'A' AND l_linenumber % 2 = 0) THEN (700 + p_size % 5)::DOUBLE END AS height,
         CASE o_orderstatus WHEN 'F' THEN 'physical' WHEN 'O' THEN 'consecutive' END AS mode,
         CASE WHEN o_orderstatus <> 'P' THEN 1 + o_custkey % 5 END AS start,
         CASE WHEN l_returnflag <> 'A' THEN p_brand END AS name,
         l_returnflag <> 'A' AND p_size % 4 = 0 AS has_fields,
         sha256(p_type) AS defaults_digest,
         p_size::BIGINT AS source_pages, l_partkey, l_suppkey, l_linenumber::BIGINT AS line, l_quantity
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
               l_shipdate, l_extendedprice, l_quantity) AS pos FROM lineitem) l
  JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

# One step per item, the way a person would assemble the packet: count pages so far, add a
# blank before an odd start when the count is odd.
FX2_FOLD = """folded(packet_id, pos, pad, first_page, last_page) AS (
  SELECT packet_id, pos, 0::BIGINT, 1::BIGINT, pages FROM fx2 WHERE pos = 1
  UNION ALL
  SELECT i.packet_id, i.pos, CASE WHEN i.odd AND f.last_page % 2 = 1 THEN 1::BIGINT ELSE 0::BIGINT END,
         f.last_page + 1 + CASE WHEN i.odd AND f.last_page % 2 = 1 THEN 1 ELSE 0 END,
         f.last_page + i.pages + CASE WHEN i.odd AND f.last_page % 2 = 1 THEN 1 ELSE 0 END
  FROM folded f JOIN fx2 i ON i.packet_id = f.packet_id AND i.pos = f.pos + 1),
parts AS MATERIALIZED (
  SELECT i.packet_id, i.pos, 1 AS band, i.kind, f.first_page, f.last_page, i.pages, i.ref, i.path, i.mode, i.start,
         coalesce(i.numbering, true) AS enabled
  FROM folded f JOIN fx2 i USING (packet_id, pos)
  UNION ALL
  SELECT i.packet_id, i.pos, 0, 'padding', f.first_page - 1, f.first_page - 1, 1, i.ref, NULL, i.mode, i.start, false
  FROM folded f JOIN fx2 i USING (packet_id, pos) WHERE f.pad = 1)"""


def dealt_sources(spark, sf_dir, sources: DataFrame) -> DataFrame:
    """One row per source, dealt by path as widely as the items where a join with these is sorted."""
    if table(spark, sf_dir, "part").count() <= SORTED_PARTS:
        return sources
    return spread(sources, task_count(spark, table(spark, sf_dir, "lineitem").count()), "path")


def part_pages(spark, sf_dir) -> DataFrame:
    """Original pages of every source, with sizes that change inside a source."""
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("path"), "p_size")
    # sources are dealt before their pages are listed: no page row is shuffled to be with its source
    parts = spread(parts, task_count(spark, parts.agg(F.sum("p_size")).first()[0] or 0), "path")
    pages = parts.select("*", F.explode(F.expr("sequence(1L, cast(p_size as bigint))")).alias("page"))
    return pages.select(
        "path",
        "page",
        (500 + F.col("p_size") + F.when(F.col("page") % 5 == 0, 40).otherwise(0)).cast("double").alias("width"),
        (700 + F.col("p_size") % 5).cast("double").alias("height"),
    )


PART_PAGES = """part_pages AS (
  SELECT 'part/' || p_partkey AS path, page, (500 + p_size + CASE WHEN page % 5 = 0 THEN 40 ELSE 0 END)::DOUBLE AS width,
         (700 + p_size % 5)::DOUBLE AS height
  FROM (SELECT *, unnest(range(1, p_size::BIGINT + 1)) AS page FROM part))"""


# --- the region / nation / customer / order tree --------------------------------------

def order_tree(spark, sf_dir) -> DataFrame:
    """One packet per region.  ``path`` holds the ids from the root, ``order_path`` the positions."""
    region = table(spark, sf_dir, "region")
    nation = table(spark, sf_dir, "nation")
    customer = table(spark, sf_dir, "customer")
    orders = table(spark, sf_dir, "orders")
    rid = F.concat(F.lit("R"), F.col("r_regionkey").cast("string"))
    nid = F.concat(F.lit("N"), F.col("n_nationkey").cast("string"))
    cid = F.concat(F.lit("C"), F.col("c_custkey").cast("string"))
    oid = F.concat(F.lit("O"), F.col("o_orderkey").cast("string"))
    number = lambda name: F.col(name).cast("bigint")
    none = lambda kind: F.lit(None).cast(kind)

    def rows(frame, ids, order, setting, own, titled, lost, opened, leaf):
        return frame.select(
            F.col("r_regionkey").cast("bigint").alias("packet_id"), ids[-1].alias("node"),
            (ids[-2] if len(ids) > 1 else none("string")).alias("parent"), order[-1].alias("pos"),
            F.array(*ids).alias("path"), F.array(*order).alias("order_path"),
            setting.alias("setting"), own.alias("own_name"), titled.alias("titled"), lost.alias("lost"),
            opened.alias("open"), F.lit(leaf).alias("leaf"),
        )

    rn = region.join(nation, F.col("n_regionkey") == F.col("r_regionkey"))
    rnc = rn.join(customer, F.col("c_nationkey") == F.col("n_nationkey"))
    rnco = rnc.join(orders, F.col("o_custkey") == F.col("c_custkey"))
    false, true = F.lit(False), F.lit(True)
    keys = [number("r_regionkey"), number("n_nationkey"), number("c_custkey"), number("o_orderkey")]
    ids = [rid, nid, cid, oid]
    return (
        rows(region, ids[:1], keys[:1], none("boolean"), none("string"), false, false, true, False)
        .unionByName(rows(rn, ids[:2], keys[:2], F.when(F.col("n_nationkey") % 3 == 0, False), F.col("n_name"), true, false, true, False))
        .unionByName(rows(rnc, ids[:3], keys[:3], F.when(F.col("c_custkey") % 5 == 0, True), F.col("c_mktsegment"), F.col("c_custkey") % 2 == 0, false, F.col("c_acctbal") > 0, False))
        .unionByName(rows(rnco, ids, keys, none("boolean"), none("string"), false, F.col("o_orderstatus") == "F", true, True))
    )


FX3 = """fx3 AS MATERIALIZED (
  SELECT r_regionkey::BIGINT AS packet_id, 'R' || r_regionkey AS node, NULL AS parent, r_regionkey::BIGINT AS pos,
         NULL::BOOLEAN AS setting, NULL AS own_name, false AS titled, false AS lost, true AS open, false AS leaf FROM region
  UNION ALL
  SELECT n_regionkey, 'N' || n_nationkey, 'R' || n_regionkey, n_nationkey,
         CASE WHEN n_nationkey % 3 = 0 THEN false END, n_name, true, false, true, false FROM nation
  UNION ALL
  SELECT n_regionkey, 'C' || c_custkey, 'N' || c_nationkey, c_custkey,
         CASE WHEN c_custkey % 5 = 0 THEN true END, c_mktsegment, c_custkey % 2 = 0, false, c_acctbal > 0, false
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL
  SELECT n_regionkey, 'O' || o_orderkey, 'C' || o_custkey, o_orderkey, NULL, NULL, false, o_orderstatus = 'F', true, true
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

# Every (ancestor, node) pair with the distance, by walking up one parent at a time.
FX3_UP = """up(packet_id, node, ancestor, distance) AS (
  SELECT packet_id, node, node, 0 FROM fx3
  UNION ALL
  SELECT u.packet_id, u.node, p.parent, u.distance + 1 FROM up u JOIN fx3 p ON p.node = u.ancestor WHERE p.parent IS NOT NULL)"""

FX3_DOWN = """down(packet_id, node, order_path, depth) AS (
  SELECT packet_id, node, [pos], 0 FROM fx3 WHERE parent IS NULL
  UNION ALL
  SELECT c.packet_id, c.node, list_append(d.order_path, c.pos), d.depth + 1 FROM down d JOIN fx3 c ON c.parent = d.node)"""


# --- conversations as sections --------------------------------------------------------

def conversation_turns(spark, sf_dir) -> tuple[DataFrame, bool]:
    turns = table(spark, sf_dir, "conversations")
    split = exceeds_group_limit(turns, ["conv_id"], table=True)
    placed = with_positions(turns, ["conv_id"], ["turn"], "pos", split)
    rows = placed.select(
        F.col("conv_id").alias("packet_id"), "pos", "turn", (F.col("role") == "user").alias("opens"),
        (1 + F.expr("cast(length(text) as bigint) div 400")).alias("pages"),
        F.col("text").alias("title"),
        (12 + 6 * (F.length("text") % 4)).cast("bigint").alias("height"),
        F.concat_ws("/", F.lit("turn"), F.col("conv_id"), F.col("turn")).alias("ref"),
    )
    return rows, split


FX4 = """fx4 AS MATERIALIZED (
  SELECT conv_id AS packet_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, turn, role = 'user' AS opens,
         1 + length(text) // 400 AS pages, text AS title, (12 + 6 * (length(text) % 4))::BIGINT AS height,
         'turn/' || conv_id || '/' || turn AS ref
  FROM conversations)"""

FX4_FOLD = """fold4(packet_id, pos, pad, first_page, last_page, section) AS (
  SELECT packet_id, pos, 0::BIGINT, 1::BIGINT, pages, CASE WHEN opens THEN ref END FROM fx4 WHERE pos = 1
  UNION ALL
  SELECT i.packet_id, i.pos, CASE WHEN i.opens AND f.last_page % 2 = 1 THEN 1::BIGINT ELSE 0::BIGINT END,
         f.last_page + 1 + CASE WHEN i.opens AND f.last_page % 2 = 1 THEN 1 ELSE 0 END,
         f.last_page + i.pages + CASE WHEN i.opens AND f.last_page % 2 = 1 THEN 1 ELSE 0 END,
         CASE WHEN i.opens THEN i.ref ELSE f.section END
  FROM fold4 f JOIN fx4 i ON i.packet_id = f.packet_id AND i.pos = f.pos + 1)"""


# --- page links -----------------------------------------------------------------------

def page_links(spark, sf_dir) -> DataFrame:
    """Every href of every page with its ordinal, and the page's own url as ordinal 0."""
    pages = table(spark, sf_dir, "pages")
    hrefs = F.concat(F.array("url"), F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    return pages.select(
        "page_id", F.regexp_extract("url", r"^([a-z]+://[^/]+)", 1).alias("base"),
        F.posexplode(hrefs).alias("ordinal", "href"),
    ).withColumn("ordinal", F.col("ordinal").cast("bigint"))


FX5 = """fx5 AS MATERIALIZED (
  SELECT page_id, regexp_extract(url, '^([a-z]+://[^/]+)', 1) AS base, (i - 1)::BIGINT AS ordinal, hrefs[i] AS href
  FROM (SELECT *, list_prepend(url, regexp_extract_all(html, 'href="([^"]*)"', 1)) AS hrefs FROM pages),
       unnest(range(1, len(hrefs) + 1)) AS t(i))"""


# --- events as findings ---------------------------------------------------------------

def event_split(spark, sf_dir) -> bool:
    """Whether some user has more events than one task should sort."""
    return exceeds_group_limit(table(spark, sf_dir, "events"), ["user_id"], table=True)


def event_findings(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    code = (
        F.when((kind == "error") & (F.col("value") < 250), "source_unreadable")
        .when(kind == "error", "interrupted")
        .when(kind == "purchase", "source_invalid")
        .when(kind == "click", "destinations_renamed")
        .when(kind == "view", "source_navigation_removed")
        .otherwise("form_fields_renamed")
    )
    return events.select(
        F.col("user_id").alias("packet_id"), F.col("event_id").alias("seq"), code.alias("code"),
        F.when(kind != "view", F.concat(F.lit("f"), (F.col("user_id") % 50).cast("string"))).alias("file"),
        kind.alias("identity_kind"), (F.col("event_id") % 2).cast("string").alias("phase"),
        F.array(F.col("props")).alias("parameters"),
        F.array(kind, F.concat(F.lit("i"), (F.col("event_id") % 7).cast("string"))).alias("items"),
        F.lit(None).cast("string").alias("setting"), F.lit(None).cast("string").alias("location"),
    )


FX6 = """fx6 AS MATERIALIZED (
  SELECT user_id AS packet_id, event_id AS seq,
         CASE WHEN event_type = 'error' AND value < 250 THEN 'source_unreadable' WHEN event_type = 'error' THEN 'interrupted'
              WHEN event_type = 'purchase' THEN 'source_invalid' WHEN event_type = 'click' THEN 'destinations_renamed'
              WHEN event_type = 'view' THEN 'source_navigation_removed' ELSE 'form_fields_renamed' END AS code,
         CASE WHEN event_type = 'error' AND value < 250 THEN 2 WHEN event_type = 'error' THEN 3
              WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS priority,
         CASE WHEN event_type <> 'view' THEN 'f' || user_id % 50 END AS file,
         event_type AS identity_kind, (event_id % 2)::VARCHAR AS phase, props,
         [event_type, 'i' || event_id % 7] AS items
  FROM events)"""


# --- embeddings as page boxes ---------------------------------------------------------

BOX_FIT_W, BOX_FIT_H, BOX_TOLERANCE = 15.0, 20.0, 5.0


def embedding_boxes(spark, sf_dir) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    box = lambda first: F.transform(F.slice("embedding", first, 4), lambda x: x.cast("double") * 100)
    return vectors.select(
        F.col("vec_id").alias("page"), box(1).alias("media"), box(5).alias("crop"),
        (90 * (F.col("label") % 4)).cast("bigint").alias("rotate"), (1 + F.col("label") % 2).cast("double").alias("unit"),
        F.when(F.col("vec_id") % 3 == 0, box(9)).alias("bleed"), F.when(F.col("vec_id") % 4 == 0, box(13)).alias("trim"),
        F.lit(None).cast("array<double>").alias("art"),
    )


FX7 = """fx7 AS MATERIALIZED (
  SELECT vec_id AS page, list_transform(embedding[1:4], lambda x: x::DOUBLE * 100) AS media,
         list_transform(embedding[5:8], lambda x: x::DOUBLE * 100) AS crop,
         (90 * (label % 4))::BIGINT AS rotate, (1 + label % 2)::DOUBLE AS unit,
         vec_id % 3 = 0 AS has_bleed, vec_id % 4 = 0 AS has_trim
  FROM embeddings),
boxes AS (
  SELECT *, greatest(least(media[1], media[3]), least(crop[1], crop[3])) AS x0,
         greatest(least(media[2], media[4]), least(crop[2], crop[4])) AS y0,
         least(greatest(media[1], media[3]), greatest(crop[1], crop[3])) AS x1,
         least(greatest(media[2], media[4]), greatest(crop[2], crop[4])) AS y1
  FROM fx7),
shown AS MATERIALIZED (
  SELECT *, CASE WHEN rotate % 180 <> 0 THEN (y1 - y0) * unit ELSE (x1 - x0) * unit END AS width,
         CASE WHEN rotate % 180 <> 0 THEN (x1 - x0) * unit ELSE (y1 - y0) * unit END AS height
  FROM boxes)"""


# --- parts as a graph -----------------------------------------------------------------

def part_graph(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and alias links: parent = key div 2, alias target = key div 3."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), "p_size")
    nodes = parts.select("node", F.when(F.col("node") > 0, F.expr("node div 2")).alias("parent"), F.col("node").alias("pos"))
    edges = parts.filter((F.col("p_size") > 5) & (F.col("node") > 0)).select(
        F.expr("node div 2").alias("src"), F.col("node").alias("dst")
    )
    aliases = parts.filter(F.col("p_size") > 10).select(F.col("node").alias("name"), F.expr("node div 3").alias("target"))
    return nodes, edges, aliases


FX8 = """fx8 AS MATERIALIZED (
  SELECT p_partkey AS node, CASE WHEN p_partkey > 0 THEN p_partkey // 2 END AS parent, p_size FROM part)"""
