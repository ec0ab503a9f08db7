"""Hierarchy queries over the region / nation / customer / order tree and the part graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import tree
from quire.operators.scan import exceeds_group_limit
from quire.plans import fixtures as fx
from quire.plans.registry import query, statement


#: Region, nation, customer and order.
LEVELS = 4


def packet_tree(spark, sf_dir):
    nodes = fx.order_tree(spark, sf_dir)
    return nodes, exceeds_group_limit(nodes, ["packet_id"])


@query("preorder", statement(fx.FX3, fx.FX3_DOWN, """events AS (
  SELECT d.packet_id, d.node, d.order_path, f.leaf AS is_leaf FROM down d JOIN fx3 f USING (node)
  UNION ALL
  SELECT d.packet_id, d.node || '/divider', list_append(d.order_path, -1), true FROM down d JOIN fx3 f USING (node) WHERE f.titled)""",
recursive=True, body="""
SELECT packet_id, node, row_number() OVER w AS event,
       CASE WHEN is_leaf THEN sum(CASE WHEN is_leaf THEN 1 ELSE 0 END) OVER w - 1 END::BIGINT AS leaf_index
FROM events WINDOW w AS (PARTITION BY packet_id ORDER BY order_path)"""))
def preorder(spark, sf_dir):
    nodes, split = packet_tree(spark, sf_dir)
    return tree.preorder(nodes, F.col("leaf"), F.col("titled"), split).select("packet_id", "node", "event", "leaf_index")


@query("inherit_nearest", statement(fx.FX3, fx.FX3_UP, recursive=True, body="""
SELECT u.packet_id, u.node, arg_min(a.setting, u.distance) FILTER (a.setting IS NOT NULL) AS setting_inherited,
       arg_min(a.own_name, u.distance) FILTER (a.own_name IS NOT NULL) AS own_name_inherited
FROM up u JOIN fx3 a ON a.node = u.ancestor GROUP BY u.packet_id, u.node"""))
def inherit_nearest(spark, sf_dir):
    nodes, split = packet_tree(spark, sf_dir)
    found = tree.inherit_nearest(nodes, ["setting", "own_name"], split=split, levels=LEVELS)
    return found.select("packet_id", "node", "setting_inherited", "own_name_inherited")


STYLE_BUILTINS = {"size": 24.0, "align": "center", "font": "default"}


@query("layer_defaults", statement(fx.FX2, body="""
SELECT packet_id, pos, coalesce(CASE WHEN line % 3 = 0 THEN line::DOUBLE - 3 END, CASE WHEN mode = 'physical' THEN 10.0::DOUBLE END, 24.0::DOUBLE) AS size,
       coalesce(CASE WHEN line % 2 = 0 THEN '' END, CASE WHEN mode IS NOT NULL THEN mode END, 'center') AS align,
       coalesce(name, CASE WHEN start > 3 THEN 'font' || start END, 'default') AS font,
       CASE WHEN line % 3 = 0 THEN 'item' WHEN mode = 'physical' THEN 'packet' ELSE 'builtin' END AS size_from,
       CASE WHEN line % 2 = 0 THEN 'item' WHEN mode IS NOT NULL THEN 'packet' ELSE 'builtin' END AS align_from,
       CASE WHEN name IS NOT NULL THEN 'item' WHEN start > 3 THEN 'packet' ELSE 'builtin' END AS font_from
FROM fx2"""))
def layer_defaults(spark, sf_dir):
    items, _ = fx.order_items(spark, sf_dir)
    styled = items.select(
        "packet_id", "pos",
        F.when(F.col("line") % 3 == 0, F.col("line").cast("double") - 3).alias("size"),
        F.when(F.col("line") % 2 == 0, "").alias("align"), F.col("name").alias("font"),
    )
    orders = fx.table(spark, sf_dir, "orders")
    start = 1 + F.col("o_custkey") % 5
    mode = F.when(F.col("o_orderstatus") == "F", "physical").when(F.col("o_orderstatus") == "O", "consecutive")
    packets = orders.select(
        F.col("o_orderkey").alias("packet_id"), F.when(mode == "physical", F.lit(10.0)).alias("size"), mode.alias("align"),
        F.when(mode.isNotNull() & (start > 3), F.concat(F.lit("font"), start.cast("string"))).alias("font"),
    )
    return tree.layer_defaults(styled, packets, ["size", "align", "font"], STYLE_BUILTINS)


@query("scope_paths", statement(fx.FX3, """placed AS (
  SELECT o.packet_id, o.node, n.own_name AS nation, c.own_name AS segment, c.pos AS custkey, o.pos AS orderkey
  FROM fx3 o JOIN fx3 c ON c.node = o.parent JOIN fx3 n ON n.node = c.parent WHERE o.leaf)""", body="""
SELECT packet_id, node,
       CASE WHEN orderkey % 7 = 0 THEN '/shared/' || orderkey || '.pdf'
            WHEN custkey % 4 = 0 AND orderkey % 3 = 0 THEN '/abs/' || orderkey || '.pdf'
            WHEN custkey % 4 = 0 THEN '/abs/' || segment || '/' || orderkey || '.pdf'
            WHEN orderkey % 3 = 0 THEN '/work/' || nation || '/' || orderkey || '.pdf'
            ELSE '/work/' || nation || '/' || segment || '/' || orderkey || '.pdf' END AS resolved
FROM placed"""))
def scope_paths(spark, sf_dir):
    """Nations and customers set directories; orders name files below, beside or outside them."""
    nodes, split = packet_tree(spark, sf_dir)
    kind = F.substring("node", 1, 1)
    folder = (
        F.when(kind == "N", F.concat("own_name", F.lit("/./x/..")))
        .when((kind == "C") & (F.col("pos") % 4 == 0), F.concat(F.lit("/abs/"), "own_name"))
        .when(kind == "C", F.col("own_name"))
    )
    number = F.col("pos").cast("string")
    source = F.when(
        F.col("leaf"),
        F.when(F.col("pos") % 7 == 0, F.concat(F.lit("/shared//"), number, F.lit(".pdf")))
        .when(F.col("pos") % 3 == 0, F.concat(F.lit("../"), number, F.lit(".pdf")))
        .otherwise(F.concat(F.lit("./"), number, F.lit(".pdf"))),
    )
    resolved = tree.scope_paths(nodes.withColumns({"dir": folder, "source": source}), F.lit("/work"), split, LEVELS)
    return resolved.select("packet_id", "node", "resolved")


@query("sections", statement(fx.FX3, fx.FX3_DOWN, fx.FX3_UP, """titled AS (
  SELECT d.packet_id, d.node, f.own_name, row_number() OVER (PARTITION BY d.packet_id ORDER BY d.order_path) AS section_index
  FROM down d JOIN fx3 f USING (node) WHERE f.titled)""", recursive=True, body="""
SELECT t.packet_id, t.node, t.section_index, arg_min(u.ancestor, u.distance) FILTER (a.titled AND u.distance > 0) AS parent_section,
       count(*) FILTER (a.titled AND u.distance > 0) AS depth, t.own_name
FROM titled t JOIN up u ON u.node = t.node JOIN fx3 a ON a.node = u.ancestor GROUP BY ALL"""))
def sections(spark, sf_dir):
    nodes, split = packet_tree(spark, sf_dir)
    return tree.sections(nodes, split, LEVELS)


@query("subtree_counts", statement(fx.FX3, fx.FX3_UP, """walls AS (
  SELECT u.node, min(u.distance) AS wall FROM up u JOIN fx3 a ON a.node = u.ancestor WHERE u.distance > 0 AND NOT a.open GROUP BY u.node),
counted AS (
  SELECT u.ancestor AS node, count(*) FILTER (x.leaf) AS leaves, count(*) FILTER (u.distance > 0 AND u.distance <= coalesce(w.wall, 1000)) AS visible
  FROM up u JOIN fx3 x ON x.node = u.node LEFT JOIN walls w ON w.node = u.node GROUP BY u.ancestor)""", recursive=True, body="""
SELECT f.packet_id, f.node, leaves, CASE WHEN f.open THEN visible ELSE -visible END AS visible FROM fx3 f JOIN counted USING (node)"""))
def subtree_counts(spark, sf_dir):
    nodes, split = packet_tree(spark, sf_dir)
    return tree.subtree_counts(nodes, split, LEVELS)


@query("prune_tree", statement(fx.FX3, fx.FX3_UP, recursive=True, body="""
SELECT DISTINCT a.packet_id, a.node FROM up u JOIN fx3 x ON x.node = u.node JOIN lost_map l ON l.node = u.node JOIN fx3 a ON a.node = u.ancestor WHERE NOT l.lost""".replace(
    "lost_map l", "(SELECT node, lost OR (left(node, 1) = 'C' AND pos % 2 = 1) AS lost FROM fx3) l")))
def prune_tree(spark, sf_dir):
    """Orders of status F and customers with odd keys lost their targets."""
    nodes, _ = packet_tree(spark, sf_dir)
    customers = (F.substring("node", 1, 1) == "C") & (F.col("pos") % 2 == 1)
    return tree.prune_tree(nodes.withColumn("lost", F.col("lost") | customers)).select("packet_id", "node")


def navigation(spark, sf_dir):
    """Occurrences = orders below their nearest section; each order's outline has one or two levels."""
    nodes, split = packet_tree(spark, sf_dir)
    headings, leaves = tree.outline_places(nodes, split, LEVELS)
    occurrences = leaves.select("packet_id", F.col("node").alias("occurrence"), "event", "section", F.col("node").alias("source"))
    orders = fx.table(spark, sf_dir, "orders")
    source = F.concat(F.lit("O"), F.col("o_orderkey").cast("string"))
    entry = lambda node, parent, pos, title: F.struct(
        F.lit(node).alias("node"), F.lit(parent).cast("string").alias("parent"), F.lit(pos).alias("pos"), title.alias("title")
    )
    outline = F.when(
        F.col("o_totalprice") > 100000,
        F.array(entry("top", None, 1, F.col("o_orderpriority")), entry("below", "top", 1, F.col("o_orderstatus"))),
    ).otherwise(F.array(entry("top", None, 1, F.col("o_orderpriority"))))
    outlines = orders.select(source.alias("source"), F.inline(outline))
    return headings.withColumnRenamed("own_name", "title"), occurrences, outlines


NAVIGATION = """events AS (SELECT packet_id, node, row_number() OVER (PARTITION BY packet_id ORDER BY order_path) AS event FROM down),
owner AS (
  SELECT u.node, arg_min(u.ancestor, u.distance) FILTER (a.titled) AS section,
         arg_min(u.ancestor, u.distance) FILTER (a.titled AND u.distance > 0) AS above,
         count(*) FILTER (a.titled) AS levels
  FROM up u JOIN fx3 a ON a.node = u.ancestor GROUP BY u.node)"""


@query("graft_trees", statement(fx.FX3, fx.FX3_DOWN, fx.FX3_UP, NAVIGATION, recursive=True, body="""
SELECT f.packet_id, f.node AS entry, o.above AS parent_entry, f.own_name AS title, e.event, 0 AS pos
FROM fx3 f JOIN events e USING (node) JOIN owner o USING (node) WHERE f.titled
UNION ALL
SELECT f.packet_id, f.node || '#top', o.section, r.o_orderpriority, e.event, 1
FROM fx3 f JOIN events e USING (node) JOIN owner o USING (node) JOIN orders r ON f.node = 'O' || r.o_orderkey
UNION ALL
SELECT f.packet_id, f.node || '#below', f.node || '#top', r.o_orderstatus, e.event, 1
FROM fx3 f JOIN events e USING (node) JOIN orders r ON f.node = 'O' || r.o_orderkey WHERE r.o_totalprice > 100000"""))
def graft_trees(spark, sf_dir):
    return tree.graft_trees(*navigation(spark, sf_dir))


@query("deep_outlines", statement(fx.FX3, fx.FX3_UP, """owner AS (
  SELECT u.node, count(*) FILTER (a.titled) AS levels FROM up u JOIN fx3 a ON a.node = u.ancestor GROUP BY u.node)""", recursive=True, body="""
SELECT f.packet_id, f.node AS occurrence, levels + CASE WHEN r.o_totalprice > 100000 THEN 2 ELSE 1 END AS depth
FROM fx3 f JOIN owner USING (node) JOIN orders r ON f.node = 'O' || r.o_orderkey
WHERE levels + CASE WHEN r.o_totalprice > 100000 THEN 2 ELSE 1 END > 3"""))
def deep_outlines(spark, sf_dir):
    headings, occurrences, outlines = navigation(spark, sf_dir)
    depths = outlines.groupBy("source").agg(F.count(F.lit(1)).alias("outline_depth"))
    return tree.deep_outlines(occurrences, headings, depths, 3).select("packet_id", "occurrence", "depth")


@query("qualified_names", statement(fx.FX3, """named AS (
  SELECT o.packet_id, o.node, n.own_name || '.' || c.own_name || CASE WHEN o.pos % 2 = 0 THEN '.' || o.pos ELSE '' END AS full_name,
         CASE WHEN c.pos % 3 = 0 THEN 'choice' ELSE 'text' END AS type
  FROM fx3 o JOIN fx3 c ON c.node = o.parent JOIN fx3 n ON n.node = c.parent WHERE o.leaf
  UNION ALL
  SELECT c.packet_id, c.node, n.own_name || '.' || c.own_name, CASE WHEN c.pos % 3 = 0 THEN 'choice' ELSE 'text' END
  FROM fx3 c JOIN fx3 n ON n.node = c.parent WHERE left(c.node, 1) = 'C' AND c.node NOT IN (SELECT parent FROM fx3 WHERE parent IS NOT NULL))""", body="""
SELECT packet_id, node, full_name, type FROM named"""))
def qualified_names(spark, sf_dir):
    nodes, split = packet_tree(spark, sf_dir)
    kind = F.substring("node", 1, 1)
    fields = nodes.withColumns({
        "own_name": F.when(kind == "O", F.when(F.col("pos") % 2 == 0, F.col("pos").cast("string"))).otherwise(F.col("own_name")),
        "type": F.when(kind == "N", "text").when((kind == "C") & (F.col("pos") % 3 == 0), "choice"),
    })
    return tree.qualified_names(fields, split, LEVELS)


@query("renamed_fields", statement(fx.FX3, """terminal AS (
  SELECT o.packet_id, o.node, n.own_name AS nation, c.own_name AS segment, '.' || o.pos AS rest FROM fx3 o JOIN fx3 c ON c.node = o.parent JOIN fx3 n ON n.node = c.parent WHERE o.leaf
  UNION ALL
  SELECT c.packet_id, c.node, n.own_name, c.own_name, '' FROM fx3 c JOIN fx3 n ON n.node = c.parent
  WHERE left(c.node, 1) = 'C' AND c.node NOT IN (SELECT parent FROM fx3 WHERE parent IS NOT NULL))""", body="""
SELECT packet_id, node, nation || '.' || segment || rest AS before, nation || '.scope' || rest AS after
FROM terminal WHERE segment = 'BUILDING'"""))
def renamed_fields(spark, sf_dir):
    """Fields whose full name changes when one market segment is renamed to 'scope'."""
    from quire.operators.names import renamed_fields as renamed

    nodes, split = packet_tree(spark, sf_dir)
    kind = F.substring("node", 1, 1)
    fields = nodes.withColumns({
        "own_name": F.when(kind == "O", F.col("pos").cast("string")).otherwise(F.col("own_name")), "type": F.lit("text"),
    })
    scoped = F.when((kind == "C") & (F.col("own_name") == "BUILDING"), "scope").otherwise(F.col("own_name"))
    both = tree.qualified_names(fields.withColumn("scoped", scoped), split, LEVELS, {"before": "own_name", "after": "scoped"})
    return renamed(both).select("packet_id", "node", "before", "after")


@query("check_tree", statement(fx.FX8, """links AS (
  SELECT node, CASE WHEN node % 97 = 5 THEN node + 10000000 WHEN node % 89 = 7 THEN node ELSE parent END AS parent FROM fx8),
walk(node, top, steps) AS (
  SELECT node, parent, 0 FROM links
  UNION ALL
  SELECT w.node, l.parent, w.steps + 1 FROM walk w JOIN links l ON l.node = w.top WHERE w.steps < 64),
ends AS (
  SELECT node, max(steps) AS steps, bool_or(top IS NULL) AS rooted, bool_or(top >= 10000000) AS orphaned FROM walk GROUP BY node)""",
recursive=True, body="""
SELECT node, 'orphan' AS fault FROM links WHERE parent >= 10000000
UNION ALL
SELECT node, 'cycle' FROM ends WHERE NOT rooted AND NOT orphaned"""))
def check_tree(spark, sf_dir):
    """The part tree with some parents replaced by unknown nodes and some by the node itself."""
    nodes, _, _ = fx.part_graph(spark, sf_dir)
    parent = F.when(F.col("node") % 97 == 5, F.col("node") + 10000000).when(F.col("node") % 89 == 7, F.col("node")).otherwise(F.col("parent"))
    return tree.check_tree(nodes.withColumn("parent", parent))


@query("check_tree_counts", statement(fx.FX8, """up(node, ancestor) AS (
  SELECT node, node FROM fx8 WHERE node NOT IN (SELECT parent FROM fx8 WHERE parent IS NOT NULL)
  UNION ALL
  SELECT u.node, f.parent FROM up u JOIN fx8 f ON f.node = u.ancestor WHERE f.parent IS NOT NULL),
leaves AS (SELECT ancestor AS node, count(*) AS n FROM up GROUP BY ancestor)""", recursive=True, body="""
SELECT f.node, 'leaf_count' AS fault FROM fx8 f JOIN leaves l USING (node) WHERE l.n <> f.p_size % 4 + 1"""))
def check_tree_counts(spark, sf_dir):
    """Nodes whose claimed leaf count is not the real one."""
    nodes, _, _ = fx.part_graph(spark, sf_dir)
    sizes = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), (F.col("p_size") % 4 + 1).alias("claim"))
    return tree.check_tree(nodes.join(tree.per_node(sizes), "node"), declared="claim")


@query("reachable", statement(fx.FX8, """walk(node) AS (
  SELECT 0::BIGINT UNION SELECT f.node FROM walk w JOIN fx8 f ON f.parent = w.node WHERE f.p_size > 5)""", recursive=True, body="""
SELECT node, node IN (SELECT node FROM walk) AS reached FROM fx8"""))
def reachable(spark, sf_dir):
    nodes, edges, _ = fx.part_graph(spark, sf_dir)
    found = tree.reach(nodes, edges, nodes.filter(F.col("node") == 0))
    return found.reached.withColumn("reached", F.lit(True)).unionByName(found.unreachable.withColumn("reached", F.lit(False)))


@query("reach_packets", statement(fx.FX8, """walk(packet_id, node) AS (
  SELECT p, r FROM (VALUES (0, 0::BIGINT), (1, 0), (1, 7)) t(p, r)
  UNION
  SELECT w.packet_id, f.node FROM walk w JOIN fx8 f ON (f.parent = w.node OR (f.node // 3 = w.node AND f.p_size % 4 = 0)) AND f.node <> w.node WHERE f.p_size > 5 + 10 * w.packet_id)""", recursive=True, body="""
SELECT p::BIGINT AS packet_id, node, (p, node) IN (SELECT (packet_id, node) FROM walk) AS reached FROM fx8, (VALUES (0), (1)) t(p)"""))
def reach_packets(spark, sf_dir):
    """Two packets over the same part ids; nodes may have two predecessors, and few edges hold in the second packet."""
    parts = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), "p_size")
    packets = parts.withColumn("packet_id", F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))))
    held = packets.filter(F.col("p_size") > 5 + 10 * F.col("packet_id"))
    halves = held.select("packet_id", F.expr("node div 2").alias("src"), F.col("node").alias("dst"))
    thirds = held.filter(F.col("p_size") % 4 == 0).select("packet_id", F.expr("node div 3").alias("src"), F.col("node").alias("dst"))
    roots = spark.createDataFrame([(0, 0), (1, 0), (1, 7)], "packet_id bigint, node bigint")
    found = tree.reach(packets, halves.unionByName(thirds).filter("src <> dst"), roots, ("packet_id",))
    return found.reached.withColumn("reached", F.lit(True)).unionByName(found.unreachable.withColumn("reached", F.lit(False)))


@query("resolve_aliases", statement(fx.FX8, """walk(name, spot, steps) AS (
  SELECT node, node // 3, 1 FROM fx8 WHERE p_size > 10
  UNION ALL
  SELECT w.name, w.spot // 3, w.steps + 1 FROM walk w JOIN fx8 f ON f.node = w.spot WHERE f.p_size > 10 AND w.steps < 64),
last AS (SELECT name, arg_max(spot, steps) AS spot, max(steps) AS steps FROM walk GROUP BY name)""", recursive=True, body="""
SELECT name, CASE WHEN steps < 64 THEN spot END AS terminal,
       CASE WHEN steps >= 64 THEN 'cycle' WHEN spot % 2 = 0 THEN 'ok' ELSE 'not_standard' END AS status FROM last"""))
def resolve_aliases(spark, sf_dir):
    """Alias chains down to a terminal part; only even keys count as standard names."""
    nodes, _, aliases = fx.part_graph(spark, sf_dir)
    standard = nodes.filter(F.col("node") % 2 == 0).select(F.col("node").alias("name"))
    return tree.resolve_aliases(aliases, standard)
