"""Hierarchies: document order, inheritance, sections, closures and navigation trees.

Nodes carry ``path`` (ids from the root down to the node itself) and ``order_path`` (sibling
positions along it).  Depth is bounded by the nesting limit.

What a node needs from its ancestors or descendants is found in one ordered sweep, without joining nodes to
ancestors.  In document order the ancestor at level d of a node is the last node of level d before it, and its
subtree ends before the next node of its own level or a higher one.  So one carried value per level is the whole
state of a sweep (the stack of open nodes), forwards for ancestors and backwards for ends; in a packet that outgrows a task
every chunk of the order is summed up as the stack it leaves behind (see ``scan``).
"""

from __future__ import annotations

import itertools
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.limits import MAX_NESTING
from quire.operators.scan import CarryLast, Following, GroupFirst, RunningSum, durable, group_limit, scan, with_positions

DIVIDER_POSITION = -1


def per_node(side: DataFrame) -> DataFrame:
    """The right side of a join that has about as many rows as there are nodes.

    Tables of ids are small as files and large as rows.  One such table in every round, broadcast, adds up to many times
    the input on the driver; sorted joins send it nothing.
    """
    return side.hint("merge")


def with_paths(nodes: DataFrame, limit: int | None = MAX_NESTING) -> tuple[DataFrame, DataFrame]:
    """Add ``path`` and ``order_path`` to an adjacency list: (reached, unreached).

    One join per level from the roots down, within the packet if there is a ``packet_id``.  Nodes
    that no root reaches are orphans, parts of a cycle, or deeper than ``limit`` (None: no limit).
    """
    scope = [c for c in ("packet_id",) if c in nodes.columns]
    roots = nodes.filter(F.col("parent").isNull())
    level = durable(roots.withColumns({"path": F.array("node"), "order_path": F.array("pos")}))
    reached = level
    for _ in itertools.count() if limit is None else range(limit):
        above = level.select(*scope, F.col("node").alias("parent"), F.col("path").alias("_path"), F.col("order_path").alias("_order"))
        level = durable(
            nodes.join(per_node(above), [*scope, "parent"]).select(
                *nodes.columns,
                F.concat("_path", F.array("node")).alias("path"),
                F.concat("_order", F.array("pos")).alias("order_path"),
            )
        )
        if level.isEmpty():
            break
        reached = reached.unionByName(level)
    return reached, nodes.join(per_node(reached.select(*scope, "node").distinct()), [*scope, "node"], "left_anti")


def ancestors(nodes: DataFrame, fields: tuple = (), own: bool = True) -> DataFrame:
    """(node, ancestor, depth of the ancestor) pairs, the node itself included if ``own``."""
    path = F.col("path") if own else F.expr("slice(path, 1, size(path) - 1)")
    rows = nodes.select("packet_id", "node", *fields, F.posexplode(path).alias("depth", "ancestor"))
    return rows


class Sweep:
    """Nodes in document order: ``rows`` with ``_enter`` (1, 2, ...) and ``_depth`` (0 = root).

    ``levels`` bounds the depth and ``split`` says whether a packet outgrows a task; what the caller does not know is
    measured in one pass.  ``order`` is ``path`` where any order of siblings will do.
    """

    def __init__(self, nodes: DataFrame, order: str = "path", split: bool | None = None, levels: int | None = None):
        if split is None or levels is None:
            sizes = nodes.groupBy("packet_id").agg(F.count(F.lit(1)).alias("_n"), F.max(F.size("path")).alias("_d"))
            rows, deepest = sizes.agg(F.max("_n"), F.max("_d")).first()
            split = (rows or 0) > group_limit(nodes.sparkSession) if split is None else split
            levels = (deepest or 1) if levels is None else levels
        self.split, self.levels = split, levels
        placed = nodes.withColumn("_depth", F.size("path") - 1)
        self.rows = with_positions(placed, ["packet_id"], [order], "_enter", split)

    def scan(self, specs: list, rows: DataFrame | None = None, back: bool = False) -> DataFrame:
        """Ordered columns of ``scan``, from the last node to the first if ``back``."""
        rows = self.rows if rows is None else rows
        if not back:
            return scan(rows, ["packet_id"], ["_enter"], specs, self.split)
        return scan(rows.withColumn("_back", -F.col("_enter")), ["packet_id"], ["_back"], specs, self.split).drop("_back")

    def above(self, fields: list[str], specs: list = ()) -> tuple[DataFrame, list[Column]]:
        """The rows, and one struct (``node`` and ``fields``) per level: the strict ancestor there, else null."""
        carried = [CarryLast(f"_up{d}", F.when(F.col("_depth") == d, F.struct("node", *fields))) for d in range(self.levels - 1)]
        found = self.scan([*carried, *specs]) if carried or specs else self.rows
        # rows whose ancestor is missing meet another node there
        real = [(F.col("_depth") > d) & (F.get("path", F.lit(d)) == F.col(f"_up{d}.node")) for d in range(self.levels - 1)]
        return found, [F.when(r, F.col(f"_up{d}")) for d, r in enumerate(real)]


def check_tree(nodes: DataFrame, limit: int = MAX_NESTING, declared: str | None = None) -> DataFrame:
    """Faults of an adjacency list: orphan, several parents, cycle, too deep, wrong leaf count.

    ``declared`` names a column with the leaf count a node claims (null = no claim).  With a
    ``packet_id``, nodes are known by packet and id, and the faults carry both.
    """
    if "packet_id" in nodes.columns:
        within = lambda c: F.when(F.col(c).isNotNull(), F.struct("packet_id", F.col(c).alias("id"))).alias(c)
        faults = check_tree(nodes.select(within("node"), within("parent"), *[c for c in nodes.columns if c not in ("packet_id", "node", "parent")]), limit, declared)
        return faults.select("node.packet_id", F.col("node.id").alias("node"), "fault")
    ids = nodes.select("node").distinct()
    fault = lambda rows, kind: rows.select("node", F.lit(kind).alias("fault")).distinct()
    orphans = nodes.filter(F.col("parent").isNotNull()).join(per_node(ids.withColumnRenamed("node", "parent")), "parent", "left_anti")
    # min < max says "two parents" and combines before the shuffle
    several = nodes.groupBy("node").agg(
        F.min("parent").alias("_low"), F.max("parent").alias("_high"), F.count(F.lit(1)).alias("_rows")
    ).filter((F.col("_low") < F.col("_high")) | (F.col("_rows") > 1)).select("node")
    single = nodes.join(per_node(several), "node", "left_anti").select("node", "parent", "pos")
    # Follow every parent chain to its end.  A chain that ends at a root tells the depth; one
    # that ends elsewhere hangs on an orphan or a twice-bound node, which is named already.
    chains = single.filter(F.col("parent").isNotNull()).select(F.col("node").alias("name"), F.col("parent").alias("target"))
    ends = follow_chains(chains).withColumnRenamed("name", "node")
    roots = single.filter(F.col("parent").isNull()).select(F.col("node").alias("terminal"))
    deep = ends.filter(~F.col("cyclic") & (F.col("hops") > limit)).join(per_node(roots), "terminal", "left_semi")
    faults = (
        fault(orphans, "orphan").unionByName(fault(several, "several_parents"))
        .unionByName(fault(deep, "too_deep")).unionByName(fault(ends.filter("cyclic"), "cycle"))
    )
    if declared:
        reached, _ = with_paths(single, None)  # leaves that lie too deep count as well
        parents = nodes.filter(F.col("parent").isNotNull()).select(F.col("parent").alias("node")).distinct()
        leaves = reached.join(per_node(parents), "node", "left_anti")
        counts = leaves.select(F.explode("path").alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("_leaves"))
        claims = nodes.filter(F.col(declared).isNotNull()).select("node", F.col(declared).alias("_claim"))
        wrong = claims.join(per_node(reached.select("node")), "node", "left_semi").join(per_node(counts), "node", "left")
        wrong = wrong.filter(F.coalesce("_leaves", F.lit(0)) != F.col("_claim"))
        faults = faults.unionByName(fault(wrong, "leaf_count"))
    return faults


def preorder(nodes: DataFrame, leaf: Column, divider: Column | None = None, split: bool | None = None) -> DataFrame:
    """Document order with a running leaf index.

    Arrays compare element by element with a prefix first, which is preorder.  ``divider``
    marks groups that get a derived divider leaf just before their children.
    """
    rows = nodes.withColumns({"derived": F.lit(False), "_leaf": leaf})
    if divider is not None:
        derived = nodes.filter(divider).withColumns({
            "derived": F.lit(True), "_leaf": F.lit(True),
            "node": F.concat("node", F.lit("/divider")),
            "order_path": F.concat("order_path", F.array(F.lit(DIVIDER_POSITION).cast("bigint"))),
        })
        rows = rows.unionByName(derived)
    placed = with_positions(rows, ["packet_id"], ["order_path"], "event", split)
    counted = scan(placed, ["packet_id"], ["event"], [RunningSum("_leaves", F.when(F.col("_leaf"), 1).otherwise(0))], split)
    return counted.select(
        *nodes.columns, "derived", "event", F.when(F.col("_leaf"), F.col("_leaves") - 1).cast("bigint").alias("leaf_index")
    )


def inherit_nearest(nodes: DataFrame, columns: list[str], own: bool = True, split: bool | None = None, levels: int | None = None) -> DataFrame:
    """For each column, the value of the nearest ancestor (the node itself if ``own``) that has one.

    The result columns are named ``<column>_inherited``.
    """
    sweep = Sweep(nodes, "path", split, levels)
    rows, above = sweep.above(columns)
    nearest = lambda c: [F.col(c)] * own + [up.getField(c) for up in reversed(above)]
    kind = {c: nodes.schema[c].dataType for c in columns}
    return rows.select(*nodes.columns, *[F.coalesce(*nearest(c), F.lit(None).cast(kind[c])).alias(f"{c}_inherited") for c in columns])


def layer_defaults(items: DataFrame, packets: DataFrame, fields: list[str], builtins: dict) -> DataFrame:
    """Item style over packet defaults over built-ins, field by field; empty and zero count as set."""
    defaults = packets.select("packet_id", *[F.col(f).alias(f"_{f}") for f in fields])
    layered = items.join(defaults, "packet_id", "left")
    chosen = {f: F.coalesce(F.col(f), F.col(f"_{f}"), F.lit(builtins.get(f))) for f in fields}
    origin = {
        f"{f}_from": F.when(F.col(f).isNotNull(), "item").when(F.col(f"_{f}").isNotNull(), "packet").otherwise("builtin")
        for f in fields
    }
    return layered.select(*[c for c in items.columns if c not in fields], *[c.alias(n) for n, c in {**chosen, **origin}.items()])


def clean_path(path: Column) -> Column:
    """Lexically clean a path: drop ``.`` and empty steps, fold ``..``."""
    rooted = path.startswith("/")
    up = lambda acc: (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), acc), -1) != "..")

    def step(acc, part):
        return (
            F.when((part == "") | (part == "."), acc)
            .when((part == "..") & up(acc), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .when((part == "..") & rooted, acc)
            .otherwise(F.concat(acc, F.array(part)))
        )

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    joined = F.array_join(parts, "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).when(joined == "", ".").otherwise(joined)


def scope_paths(nodes: DataFrame, base: Column, split: bool | None = None, levels: int | None = None) -> DataFrame:
    """Resolve ``source`` against the directories of the enclosing groups; an absolute step restarts.

    A group's own ``dir`` is for its children only, so only strict ancestors are looked at.
    """
    rows, above = Sweep(nodes, "path", split, levels).above(["dir"])
    dirs = [up.getField("dir") for up in above]
    steps = F.filter(F.array(*dirs, F.col("source")), lambda step: step.isNotNull())
    whole = F.aggregate(
        steps, base, lambda acc, step: F.when(step.startswith("/"), step).otherwise(F.concat(acc, F.lit("/"), step))
    )
    return rows.filter(F.col("source").isNotNull()).select(*nodes.columns, clean_path(whole).alias("resolved"))


def sections(nodes: DataFrame, split: bool | None = None, levels: int | None = None) -> DataFrame:
    """Titled groups in document order with their parent section and depth.

    Untitled groups are transparent: the parent is the nearest titled ancestor.
    """
    index = RunningSum("section_index", F.when(F.col("titled"), 1).otherwise(0))
    rows, above = Sweep(nodes, "order_path", split, levels).above(["titled"], [index])
    titled = [F.when(up.getField("titled"), up.getField("node")) for up in above]
    none = F.lit(None).cast(nodes.schema["node"].dataType)
    depth = sum((F.when(t.isNotNull(), 1).otherwise(0) for t in titled), F.lit(0)).cast("bigint")
    return rows.filter("titled").select(
        "packet_id", "node", F.col("section_index").cast("bigint"), F.coalesce(*reversed(titled), none).alias("parent_section"), depth.alias("depth"), "own_name"
    )


class Reach(NamedTuple):
    """Nodes that a walk along the edges reaches from the roots (roots included), and all others."""

    reached: DataFrame
    unreachable: DataFrame


def reach(nodes: DataFrame, edges: DataFrame, roots: DataFrame, scope: tuple = ()) -> Reach:
    """Split ``nodes`` by whether a walk along ``edges`` (src, dst) leads there from the ``roots``.

    With a ``scope`` (such as ``packet_id``) nodes are known by it and their id, and so are roots and edges.  Edges from
    or to unknown nodes lead nowhere.

    In every phase the nodes next to what was reached last are entries, every other node points to one of its
    predecessors, and pointers are doubled: a node whose pointers lead to an entry is reached.  So chains and trees of
    any depth take a logarithm of it in rounds, in one phase; a further phase is needed only where the chosen predecessors led
    astray, and chooses others.  What is reached is only ever appended, and what still moves shrinks from round to round.
    """
    key = [*scope, "node"]
    known = durable(nodes.select(*key).distinct())
    named = lambda frame, name: frame.select(*scope, F.col("node").alias(name))
    delta = durable(roots.select(*key).distinct().join(per_node(known), key, "left_semi"))
    reached = [delta]
    rest = durable(known.join(per_node(delta), key, "left_anti"))
    phase = 0
    while True:
        entries = edges.join(per_node(named(delta, "src")), [*scope, "src"], "left_semi").select(*scope, F.col("dst").alias("node")).distinct()
        entries = durable(entries.join(per_node(rest), key, "left_semi"))
        if entries.isEmpty():
            return Reach(reduce(DataFrame.unionByName, reached), rest)
        waiting = rest.join(per_node(entries), key, "left_anti")
        between = edges.join(per_node(named(rest, "src")), [*scope, "src"], "left_semi").join(per_node(named(waiting, "dst")), [*scope, "dst"], "left_semi")
        chosen = between.groupBy(*scope, F.col("dst").alias("node")).agg(F.min_by("src", F.xxhash64("src", F.lit(phase))).alias("to"))
        moving, done = durable(chosen), [entries]
        while not moving.isEmpty():
            settled = reduce(DataFrame.unionByName, done).select(*scope, F.col("node").alias("to"), F.lit(True).alias("_hit"), F.lit(None).cast(chosen.schema["to"].dataType).alias("_far"))
            ahead = settled.unionByName(moving.select(*scope, F.col("node").alias("to"), F.lit(False).alias("_hit"), F.col("to").alias("_far")))
            jumped = durable(moving.join(per_node(ahead), [*scope, "to"]).select(*key, "_hit", "_far"))  # dead ends drop out
            hits = jumped.filter("_hit").select(*key)
            if hits.isEmpty():
                break
            done.append(hits)
            moving = jumped.filter(~F.col("_hit")).select(*key, F.col("_far").alias("to"))
        delta = durable(reduce(DataFrame.unionByName, done))
        reached.append(delta)
        rest = durable(rest.join(per_node(delta), key, "left_anti"))
        phase += 1


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes that a walk along the edges reaches from the roots; both frames are by id only."""
    nodes = edges.select(F.col("dst").alias("node")).union(edges.select("src")).union(roots.select("node"))
    return reach(nodes, edges, roots).reached


def follow_chains(links: DataFrame) -> DataFrame:
    """The end of every chain of single links by pointer doubling: (name, terminal, hops, cyclic).

    Each round doubles the distance looked ahead, so a chain of n links takes log2(n) joins.  A
    chain that still moves after as many hops as there are links must repeat a name.
    """
    current = durable(links.select("name", F.col("target").alias("terminal"), F.lit(1).cast("bigint").alias("hops")))
    total, reach = current.count(), 1
    while True:
        ahead = current.select(F.col("name").alias("terminal"), F.col("terminal").alias("_far"), F.col("hops").alias("_more"))
        moved = durable(
            current.join(per_node(ahead), "terminal", "left").select(
                "name", F.coalesce("_far", "terminal").alias("terminal"),
                (F.col("hops") + F.coalesce("_more", F.lit(0))).alias("hops"), F.col("_far").isNotNull().alias("cyclic"),
            )
        )
        reach *= 2
        if reach > total or moved.filter("cyclic").isEmpty():
            break
        current = moved.drop("cyclic")
    # after the last round only names on or before a cycle still have a link to follow
    heads = links.select(F.col("name").alias("terminal"), F.lit(True).alias("_link"))
    return moved.drop("cyclic").join(per_node(heads), "terminal", "left").select(
        "name", "terminal", "hops", F.col("_link").isNotNull().alias("cyclic")
    )


def resolve_aliases(links: DataFrame, standard: DataFrame | None = None) -> DataFrame:
    """Follow alias links to the terminal name: (name, terminal, status).

    Names that lead into a cycle have no terminal.  ``standard`` lists the admissible ends.  With a ``packet_id`` in
    ``links``, names are known by packet and name (a standard name without a packet holds for all of them).
    """
    if "packet_id" in links.columns:
        within = lambda c: F.struct("packet_id", F.col(c).alias("id"))
        found = follow_chains(links.select(within("name").alias("name"), within("target").alias("target")))
        flat = found.select("name.packet_id", F.col("name.id").alias("name"), F.col("terminal.id").alias("terminal"), "cyclic")
        keys = ["packet_id", "terminal"] if standard is not None and "packet_id" in standard.columns else ["terminal"]
        known = None if standard is None else standard.withColumnRenamed("name", "terminal").select(*keys, F.lit(True).alias("_known")).distinct()
        joined = flat.withColumn("_known", F.lit(True)) if known is None else flat.join(per_node(known), keys, "left")
        status = F.when(F.col("cyclic"), "cycle").when(F.col("_known").isNull(), "not_standard").otherwise("ok")
        return joined.select("packet_id", "name", F.when(~F.col("cyclic"), F.col("terminal")).alias("terminal"), status.alias("status"))
    joined = follow_chains(links)
    cyclic = F.col("cyclic")
    if standard is None:
        status = F.when(cyclic, "cycle").otherwise("ok")
        return joined.select("name", F.when(~cyclic, F.col("terminal")).alias("terminal"), status.alias("status"))
    known = standard.select(F.col("name").alias("terminal"), F.lit(True).alias("_known")).distinct()
    status = F.when(cyclic, "cycle").when(F.col("_known").isNull(), "not_standard").otherwise("ok")
    return joined.join(per_node(known), "terminal", "left").select(
        "name", F.when(~cyclic, F.col("terminal")).alias("terminal"), status.alias("status")
    )


def subtree_counts(nodes: DataFrame, split: bool | None = None, levels: int | None = None) -> DataFrame:
    """Leaves below each node, and visible descendants: those with no closed node in between.

    A node is visible from its ancestors at or below its nearest closed strict ancestor.  The
    count of a closed node is negative.  Both are differences of running counts between a node and the end of its subtree.
    """
    sweep = Sweep(nodes.select("packet_id", "node", "path", "open", "leaf"), "path", split, levels)
    rows, above = sweep.above(["open"])
    walls = [F.when(~up.getField("open"), d) for d, up in enumerate(above)]
    walled = rows.select("packet_id", "node", "open", "leaf", "_depth", "_enter", F.coalesce(F.greatest(*walls) if len(walls) > 1 else F.coalesce(*walls, F.lit(None).cast("int")), F.lit(0)).alias("_wall"))
    if sweep.split:
        walled = durable(walled)  # each further scan looks at its rows twice, which need not repeat the scan above with all paths
    seen = lambda d: F.when((F.col("_wall") <= d) & (F.col("_depth") > d), 1).otherwise(0)
    leaf = F.col("leaf").cast("int")
    counted = sweep.scan([RunningSum("_l", leaf), *[RunningSum(f"_v{d}", seen(d)) for d in range(sweep.levels)]], walled)
    # counts before a node, for the nodes whose subtree it ends; at the end of the packet, all
    before = F.struct(F.col("_enter").alias("at"), (F.col("_l") - leaf).alias("l"), F.array(*[F.col(f"_v{d}") - seen(d) for d in range(sweep.levels)]).alias("v"))
    everything = F.struct((F.col("_enter") + 1).alias("at"), F.col("_l").alias("l"), F.array(*[F.col(f"_v{d}") for d in range(sweep.levels)]).alias("v"))
    boxed = counted.select("packet_id", "node", "open", "leaf", "_depth", "_enter", before.alias("_before"), everything.alias("_all"))
    specs = [CarryLast(f"_next{d}", F.when(F.col("_depth") == d, F.col("_before"))) for d in range(sweep.levels)]
    ended = sweep.scan([*specs, GroupFirst("_last", F.col("_all"))], boxed, back=True)
    end = F.least(F.col("_last"), *[F.when(F.col("_depth") >= d, F.col(f"_next{d}")) for d in range(sweep.levels)])
    own = ended.withColumn("_end", end)
    visible = F.get("_end.v", "_depth") - F.get("_before.v", "_depth")
    return own.select(
        "packet_id", "node", F.when(F.col("leaf"), F.lit(1)).otherwise(F.col("_end.l") - F.col("_before.l")).cast("bigint").alias("leaves"),
        F.when(F.col("open"), visible).otherwise(-visible).cast("bigint").alias("visible"),
    )


def prune_tree(nodes: DataFrame) -> DataFrame:
    """Drop ``lost`` nodes without a surviving descendant; dead parents of live children stay."""
    alive = nodes.filter(~F.col("lost")).select("packet_id", F.explode("path").alias("node")).distinct()
    return nodes.join(alive, ["packet_id", "node"], "left_semi")


def graft_trees(sections_: DataFrame, occurrences: DataFrame, outlines: DataFrame) -> DataFrame:
    """One navigation tree per packet: authored sections, and each occurrence's own outline
    below its nearest section, or at the root.

    ``occurrences``: packet_id, occurrence, event, section (null = root), source.
    ``outlines``: source, node, parent, pos, title — one tree per source, used many times.
    """
    authored = sections_.select(
        "packet_id", F.col("node").alias("entry"), F.col("parent_section").alias("parent_entry"), "title",
        F.col("event").alias("event"), F.lit(0).cast("bigint").alias("pos"),
    )
    placed = outlines.join(occurrences, "source")
    key = lambda node: F.concat_ws("#", F.col("occurrence"), node)
    imported = placed.select(
        "packet_id", key(F.col("node")).alias("entry"),
        F.when(F.col("parent").isNull(), F.col("section")).otherwise(key(F.col("parent"))).alias("parent_entry"),
        "title", "event", F.col("pos").cast("bigint").alias("pos"),
    )
    return authored.unionByName(imported)


def deep_outlines(occurrences: DataFrame, sections_: DataFrame, depths: DataFrame, limit: int) -> DataFrame:
    """Occurrences whose section depth plus own outline depth passes the limit.

    ``depths`` holds the deepest outline level per source (1 = flat).
    """
    levels = sections_.select("packet_id", F.col("node").alias("section"), (F.col("depth") + 1).alias("_section_depth"))
    joined = occurrences.join(depths, "source").join(levels, ["packet_id", "section"], "left")
    total = F.coalesce("_section_depth", F.lit(0)) + F.col("outline_depth")
    return joined.select("packet_id", "occurrence", "source", total.alias("depth")).filter(F.col("depth") > limit).withColumn(
        "code", F.lit("source_outline_depth_unsupported")
    )


def outline_places(nodes: DataFrame, split: bool | None = None, levels: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(sections, leaves) of packets in one sweep: document order ``event``, the nearest titled group and depths.

    Sections carry ``parent_section``, ``depth`` and ``own_name``; a leaf carries its nearest ``section``, itself included.
    """
    slim = nodes.select("packet_id", "node", "path", "order_path", "titled", "leaf", "own_name")
    rows, above = Sweep(slim, "order_path", split, levels).above(["titled"])
    titled = [F.when(up.getField("titled"), up.getField("node")) for up in above]
    parent = F.coalesce(*reversed(titled), F.lit(None).cast(nodes.schema["node"].dataType))
    depth = sum((F.when(t.isNotNull(), 1).otherwise(0) for t in titled), F.lit(0)).cast("bigint")
    placed = durable(rows.select(
        "packet_id", "node", F.col("_enter").alias("event"), parent.alias("parent_section"), depth.alias("depth"), "own_name", "titled", "leaf"))
    section = F.when(F.col("titled"), F.col("node")).otherwise(F.col("parent_section"))
    return (placed.filter("titled").select("packet_id", "node", "event", "parent_section", "depth", "own_name"),
            placed.filter("leaf").select("packet_id", "node", "event", section.alias("section")))


def qualified_names(fields: DataFrame, split: bool | None = None, levels: int | None = None, named: dict | None = None) -> DataFrame:
    """Dotted full names of terminal fields; unnamed levels add nothing, the type is inherited.

    ``named`` gives the column of own names for every full name wanted; by default ``full_name`` is made of ``own_name``.
    """
    named = named or {"full_name": "own_name"}
    own = list(dict.fromkeys(named.values()))
    sweep = Sweep(fields.select("packet_id", "node", "path", "type", *own), "path", split, levels)
    rows, above = sweep.above([*own, "type"], [Following("_next", F.col("path"))])
    terminal = ~F.coalesce(F.get("_next", "_depth") == F.col("node"), F.lit(False))
    # one entry per level; nulls are left out
    full = {out: F.array_join(F.array(*[up.getField(c) for up in above], F.col(c)), ".") for out, c in named.items()}
    nearest = F.coalesce(F.col("type"), *[up.getField("type") for up in reversed(above)])
    return rows.filter(terminal).select("packet_id", "node", *[name.alias(out) for out, name in full.items()], nearest.alias("type"))
