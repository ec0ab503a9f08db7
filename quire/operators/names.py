"""Names across the sources of a packet: collisions, renames, links and paths."""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quire.operators.ranges import lookup_at
from quire.operators.scan import CarryLast, RunningSum, durable, exceeds_group_limit, scan, with_positions
from quire.operators.tree import clean_path

DEFAULT_PREFIX = "packet.destination"


def rename_collisions(names: DataFrame, prefix: str = DEFAULT_PREFIX, split: bool | None = None, tasks: int | None = None) -> DataFrame:
    """New name of every named target of a packet, in (part, name) order.

    ``names``: packet_id, part, name, page; one row per name of a part.  Names without a page
    are dropped and not counted.  The first use keeps its name; a later one becomes
    ``prefix.N`` with N the running number of kept names.  Where authored names look like ``prefix.N``
    themselves, N is the next number that neither an earlier name nor a name of the same part
    (kept or dropped) has: one pass over each packet, in ``tasks`` tasks, hands them out; see ``_allocate``
    for packets larger than a task.
    """
    if split is None:
        split = exceeds_group_limit(names, ["packet_id"])
    kept = with_positions(names.filter(F.col("page").isNotNull()), ["packet_id"], ["part", "name"], "n", split)
    first = kept.groupBy("packet_id", "name").agg(F.min("n").alias("_first"))
    renamed = kept.join(first, ["packet_id", "name"]).withColumn("renamed", F.col("n") > F.col("_first")).drop("_first")
    label = lambda number: F.concat_ws(".", F.lit(prefix), number.cast("string"))
    mapped = renamed.withColumn("to", F.when(F.col("renamed"), label(F.col("n"))).otherwise(F.col("name")))
    # numbers that a generated name can have: no leading zeros, within a long
    shape = "^" + prefix.replace(".", r"\.") + r"\.([1-9][0-9]{0,17})$"
    number = F.when(F.col("name").rlike(shape), F.regexp_extract("name", shape, 1).cast("bigint"))
    shaped = names.withColumn("number", number).filter(F.col("number").isNotNull())
    if not split:
        return mapped if shaped.isEmpty() else _in_order(names, number, prefix, tasks).select(*mapped.columns)
    shaped = durable(shaped.groupBy("packet_id", "part", "number").agg(F.max(F.col("page").isNotNull()).alias("held")))
    if shaped.isEmpty():
        return mapped
    packets = shaped.select("packet_id").distinct()
    rows = durable(renamed.join(packets, "packet_id", "left_semi").withColumn("_number", number))
    found = _allocate(rows, shaped, split).withColumn("to", F.when(F.col("renamed"), label(F.col("_to"))).otherwise(F.col("name")))
    return mapped.join(packets, "packet_id", "left_anti").unionByName(found.select(*mapped.columns))


def _in_order(names: DataFrame, number: Column, prefix: str, tasks: int | None) -> DataFrame:
    """Numbers handed out along every packet, its rows sorted within one task.

    The authored numbers of a part come before its names, so nothing is held but what the packet has used.
    """
    kept, shaped = F.col("page").isNotNull(), F.col("_number").isNotNull()
    step = F.explode(F.when(kept & shaped, F.array(F.lit(0), F.lit(1))).when(kept, F.array(F.lit(1))).when(shaped, F.array(F.lit(0))))
    steps = names.withColumn("_number", number).withColumn("_step", step)
    steps = steps.repartition(*([tasks] if tasks else []), "packet_id").sortWithinPartitions("packet_id", "part", "_step", "name")
    given = T.StructType(names.schema.fields + [T.StructField("n", T.LongType()), T.StructField("renamed", T.BooleanType()), T.StructField("to", T.StringType())])
    arrow = to_arrow_schema(given)
    numbered = steps.mapInArrow(lambda batches: _hand_out(batches, prefix, arrow), given)
    return numbered.filter(F.col("packet_id").isNotNull() & F.col("name").isNotNull())


def _hand_out(batches: Iterator[pa.RecordBatch], prefix: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Kept rows with their running number, whether they are renamed, and their name; ``n``, ``renamed``, ``to``."""
    packet, part, n, last = object(), object(), 0, 0
    used: set[str] = set()
    after: dict[int, int] = {}  # a used number and one that may be the next free one
    listed: set[int] = set()  # authored numbers of this part
    for batch in batches:
        found = []
        for p, q, step, name, number in zip(*[batch.column(c).to_pylist() for c in ("packet_id", "part", "_step", "name", "_number")]):
            if p != packet:
                packet, part, n, used, after = p, object(), 0, set(), {}
            if q != part:
                part, last, listed = q, 0, set()
            if step == 0:
                listed.add(number)
                continue
            n += 1
            renamed, to = name in used, name
            if renamed:
                # within a part the numbers only rise
                number = max(n, last + 1)
                while True:
                    passed = []
                    while number in after:
                        passed.append(number)
                        number = after[number]
                    for x in passed:
                        after[x] = number
                    if number not in listed:
                        break
                    number += 1
                last, to = number, f"{prefix}.{number}"
            if name is not None:
                used.add(to)
            if number is not None:
                after[number] = number + 1
            found.append((n, renamed, to))
        if found:
            rows = batch.filter(pc.equal(batch.column("_step"), 1))
            columns = [rows.column(f.name).cast(f.type) for f in list(schema)[:-3]]
            columns += [pa.array(c, f.type) for c, f in zip(zip(*found), list(schema)[-3:])]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _allocate(rows: DataFrame, shaped: DataFrame, split: bool) -> DataFrame:
    """Numbers (``_to``) for the renamed rows of packets with authored ``prefix.N`` names, and ``renamed``.

    Numbers are handed out in row order, upwards from the row's own running number, so what was
    handed out last and the row's number decide, but for authored numbers in between.  Only rows at which authored
    numbers matter need to be looked at one by one: authored rows, the borders of their parts, and rows whose running
    number is an authored one.  Between them stretches of renamed rows are summed up as (rows, first, last); the
    fold runs over these summaries, whose number follows the authored names and not the packet.
    A row of a stretch then gets the larger of its own number and its place plus the stretch's base.
    """
    packet = ["packet_id"]
    bounds = rows.groupBy("packet_id", "part").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    reserved = durable(shaped.join(bounds, ["packet_id", "part"]))
    plain = scan(rows, packet, ["n"], [RunningSum("_rn", F.when(F.col("renamed") & F.col("_number").isNull(), 1).otherwise(0))], split)
    plain = durable(plain.filter(F.col("renamed") & F.col("_number").isNull()))
    # numbers reserved by dropped names are free again after their part: as many rows as such names may take them
    freed = reserved.filter(~F.col("held")).groupBy("packet_id", "part").agg(F.count(F.lit(1)).alias("_freed"), F.first("hi").alias("hi"))
    totals = rows.groupBy("packet_id", "part").agg(F.sum(F.when(F.col("renamed") & F.col("_number").isNull(), 1).otherwise(0)).alias("_r"))
    totals = scan(totals, packet, ["part"], [RunningSum("_until", F.col("_r"))], split)
    takers = freed.join(totals.select("packet_id", "part", "_until"), ["packet_id", "part"])
    takers = takers.select("packet_id", F.explode(F.expr("sequence(_until + 1, _until + _freed)")).alias("_rn")).distinct().join(plain.select("packet_id", "_rn", "n"), ["packet_id", "_rn"])
    border = lambda frame, *columns: frame.select("packet_id", F.explode(F.array(*columns)).alias("n"))
    one = lambda frame, name: border(frame, F.col(name), F.col(name) + 1)
    borders = border(reserved, F.col("lo"), F.col("hi") + 1).unionByName(one(reserved, "number")).unionByName(one(takers, "n"))
    borders = borders.unionByName(one(rows.filter(F.col("_number").isNotNull()), "n")).distinct()
    marked = borders.select("packet_id", "n", F.lit(0).alias("_side")).unionByName(plain.select("packet_id", "n", F.lit(1).alias("_side")))
    marked = scan(marked, packet, ["n", "_side"], [CarryLast("_stretch", F.when(F.col("_side") == 0, F.col("n")))], split).filter("_side = 1")
    stretches = marked.select("packet_id", "n", F.coalesce("_stretch", F.lit(0)).alias("_stretch"))
    stretches = durable(scan(stretches, ["packet_id", "_stretch"], ["n"], [RunningSum("_j", F.lit(1))], split))
    sums = stretches.groupBy("packet_id", "_stretch").agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("at"), F.max("n").alias("last"))
    event = lambda frame, kind, at, number="0", last="0", count="0": frame.selectExpr(
        "packet_id", f"{kind} AS kind", f"{at} AS at", f"CAST({number} AS BIGINT) AS number", f"CAST({last} AS BIGINT) AS last", f"CAST({count} AS BIGINT) AS rows")
    events = (
        event(reserved.select("packet_id", "part", "hi").distinct(), "0", "hi + 1")
        .unionByName(event(reserved.filter("held"), "1", "lo", "number", "1"))
        .unionByName(event(reserved.filter("NOT held"), "1", "lo", "number"))
        .unionByName(event(sums, "2", "at", "_stretch", "last", "rows"))
        .unionByName(event(rows.filter(F.col("_number").isNotNull()), "3", "n", "_number"))
    )
    kind = rows.schema["packet_id"].dataType.simpleString()
    schema = T.StructType.fromDDL(f"packet_id {kind}, at bigint, stretch bigint, j_first bigint, j_last bigint, base bigint, renamed boolean")
    arrow = to_arrow_schema(schema)
    ordered = events.repartition("packet_id").sortWithinPartitions("packet_id", "at", "kind", "number")
    given = durable(ordered.mapInArrow(lambda batches: _fold_packets(batches, arrow), schema))
    authored = rows.filter(F.col("_number").isNotNull()).drop("renamed").join(
        given.filter("stretch IS NULL").select("packet_id", F.col("at").alias("n"), "renamed", F.col("base").alias("_to")), ["packet_id", "n"])
    bases = given.filter("stretch IS NOT NULL").select("packet_id", F.col("stretch").alias("_stretch"), "j_first", "j_last", "base")
    placed = lookup_at(stretches, bases, ["packet_id", "_stretch"], "_j", "j_first", "j_last", ["base"], split)
    numbered = placed.select("packet_id", "n", F.greatest(F.col("_j") + F.col("base"), F.col("n")).alias("_to"))
    later = plain.drop("_rn").join(numbered, ["packet_id", "n"])
    same = rows.filter(F.col("_number").isNull() & ~F.col("renamed")).withColumn("_to", F.lit(None).cast("bigint"))
    return authored.select(*same.columns).unionByName(later.select(*same.columns)).unionByName(same)


def _fold_packets(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """``_fold`` for every packet of ordered events."""
    packet, events, found = None, [], []
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("packet_id", "kind", "at", "number", "last", "rows")]):
            if events and row[0] != packet:
                found += [(packet, *f) for f in _fold(events)]
                events = []
            packet = row[0]
            events.append(row[1:])
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)
            found = []
    found = [(packet, *f) for f in _fold(events)] if events else []
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)


def _fold(events: list[tuple]) -> list[tuple]:
    """(at, stretch, first and last place, base, renamed) of the stretches and authored rows of one packet.

    Events are (kind, at, number, last, rows) in order of place and kind: 0 a part ends, 1 a number is reserved (``last``
    1: by a name with a page), 2 a stretch, 3 an authored row.
    """
    known = sorted({e[2] for e in events if e[0] in (1, 3)})
    held: list[int] = []  # numbers of names with a page, of this and earlier parts
    dropped: list[int] = []  # numbers of names without a page of this part
    skipped: list[int] = []  # of these, numbers passed over in this part
    holes: list[int] = []  # such numbers of earlier parts
    owned: set[int] = set()  # numbers that names have
    found, last = [], 0  # the largest number handed out

    def blocked(x: int) -> bool:
        for numbers in (held, dropped):
            k = bisect_left(numbers, x)
            if k < len(numbers) and numbers[k] == x:
                return True
        return False

    def free(x: int) -> int:
        while blocked(x):
            if x in dropped:
                skipped.append(x)
            x += 1
        return x

    def single(n: int) -> int:
        nonlocal last
        fits = [h for h in holes if h >= n and h not in owned and not blocked(h)]
        if fits:
            number = min(fits)
            holes.remove(number)
        else:
            number = last = free(max(last + 1, n))
        owned.add(number)
        return number

    for kind, at, number, end, rows in events:
        if kind == 0:
            holes = sorted({h for h in [*holes, *skipped] if h >= at})
            dropped, skipped = [], []
        elif kind == 1:
            numbers = held if end else dropped
            k = bisect_left(numbers, number)
            if k == len(numbers) or numbers[k] != number:
                numbers.insert(k, number)
        elif kind == 3:
            taken = number in owned
            to = single(at) if taken else None
            owned.add(number)
            found.append((at, None, None, None, to, taken))
        elif rows == 1:
            found.append((at, number, 1, 1, single(at) - 1, True))
        else:
            start, j, x = last, 0, last + 1
            while j < rows:
                x = free(x)
                nexts = [numbers[k] for numbers in (held, dropped) if (k := bisect_left(numbers, x)) < len(numbers)]
                n = min([rows - j, *[b - x for b in nexts]])
                found.append((at, number, j + 1, j + n, x - (j + 1), True))
                j, x = j + n, x + n
            last = max(x - 1, end)
            # numbers beyond the stretch's own are reached by running ahead, one after the other
            for k in range(bisect_left(known, max(end, start) + 1), bisect_left(known, last + 1)):
                if not blocked(known[k]):
                    owned.add(known[k])
    return found


def rewrite_names(links: DataFrame, mapping: DataFrame) -> DataFrame:
    """Apply renames to every reference of the same part; other names stay."""
    renames = mapping.filter("renamed").select("packet_id", "part", "name", F.col("to").alias("_to"))
    joined = links.join(renames, ["packet_id", "part", "name"], "left")
    return joined.withColumn("name", F.coalesce("_to", "name")).drop("_to")


def predicted_renames(names: DataFrame, parts: DataFrame) -> DataFrame:
    """Warnings before building: names used by an earlier part, forms in any later part."""
    first = names.groupBy("packet_id", "name").agg(F.min("part").alias("_first"))
    again = names.join(first, ["packet_id", "name"]).filter(F.col("part") > F.col("_first"))
    repeated = again.select("packet_id", "part", "name", F.lit("destinations_renamed").alias("code")).distinct()
    forms = parts.filter(F.col("has_fields") & (F.col("part_index") > 0)).select(
        "packet_id", "part", F.lit(None).cast("string").alias("name"), F.lit("form_fields_renamed").alias("code")
    )
    return repeated.unionByName(forms)


def renamed_fields(before: DataFrame, after: DataFrame | None = None) -> DataFrame:
    """Fields whose full name changed, by field id; without ``after``, ``before`` has both names (``before``, ``after``) of each."""
    if after is None:
        return before.select("packet_id", "node", "before", "after").filter(~F.col("before").eqNullSafe(F.col("after")))
    old = before.select("packet_id", "node", F.col("full_name").alias("before"))
    new = after.select("packet_id", "node", F.col("full_name").alias("after"))
    return old.join(new, ["packet_id", "node"]).filter(~F.col("before").eqNullSafe(F.col("after")))


# --- links ------------------------------------------------------------------------------

def resolve_links(links: DataFrame, names: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split links into (live, dangling).

    A link points at a page directly or by a name of the same occurrence, and lives when that
    page is among the occurrence's selected pages.
    """
    targets = names.groupBy("occurrence", "name").agg(F.min("page").alias("_named"))
    aimed = links.join(targets, ["occurrence", "name"], "left").withColumn("target", F.coalesce("page", "_named")).drop("_named")
    selected = pages.select("occurrence", F.col("page").alias("target"), F.lit(True).alias("_live")).distinct()
    marked = aimed.join(selected, ["occurrence", "target"], "left")
    return marked.filter("_live").drop("_live"), marked.filter(F.col("_live").isNull()).drop("_live")


def removed_navigation(dangling: DataFrame, next_edges: DataFrame | None = None) -> DataFrame:
    """Distinct removed bindings (site, target, cause) and the actions that hang on them."""
    from quire.operators.tree import reachable

    removed = dangling.select("site", "target", F.lit("target_omitted").alias("cause")).dropDuplicates(["site", "target"])
    if next_edges is None:
        return removed
    gone = reachable(next_edges, removed.select(F.col("site").alias("node")).distinct())
    chained = gone.join(removed.select(F.col("site").alias("node")), "node", "left_anti").select(
        F.col("node").alias("site"), F.lit(None).cast(removed.schema["target"].dataType).alias("target"), F.lit("depends_on_removed").alias("cause")
    )
    return removed.unionByName(chained)


def relative_urls(links: DataFrame, bases: DataFrame) -> DataFrame:
    """Live links without a scheme, in sources whose URL base is dropped."""
    relative = ~F.coalesce(F.col("href").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(False))
    based = bases.filter(F.coalesce(F.length("base"), F.lit(0)) > 0).select("source").distinct()
    return links.filter(relative).join(based, "source", "left_semi").withColumn("code", F.lit("source_uri_base_removed"))


# --- paths ------------------------------------------------------------------------------

@F.pandas_udf(T.StringType())
def composed(values: pd.Series) -> pd.Series:
    """Unicode composition (NFC) of the decomposed, folded form."""
    fold = lambda text: unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).casefold())
    return values.map(fold, na_action="ignore")


# Code points without a visible form: all format characters and the default-ignorable ones
# outside that category (fixed values).
IGNORABLE = (
    r"[\p{Cf}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180D}\x{180F}\x{2065}\x{3164}"
    r"\x{FE00}-\x{FE0F}\x{FFA0}\x{FFF0}-\x{FFF8}\x{E0000}-\x{E0FFF}]"
)


def portable_key(path: Column) -> Column:
    """A key that is equal for every spelling some file system treats as one name.

    Only names with non-ASCII characters need the Unicode step; the rest is lower-cased here.
    """
    ascii_only = path.rlike(r"^[\x00-\x7F]*$")
    return F.when(ascii_only, F.lower(path)).otherwise(composed(F.when(~ascii_only, F.regexp_replace(path, IGNORABLE, ""))))


def _plain_path(path: Column) -> Column:
    """The path without ``.``, ``..`` and empty steps; a scheme stays as it is."""
    scheme = F.regexp_extract(path, r"^([A-Za-z][A-Za-z0-9+.-]*://)?", 0)
    return F.concat(scheme, clean_path(F.substr(path, F.length(scheme) + 1)))


def path_conflicts(roles: DataFrame) -> DataFrame:
    """Paths that must not coincide: packet_id, role (input, output, report), path.

    Two inputs may share a path; an output or report may share it with nothing.  Each group
    yields one row per offender against its first owner, never a row per pair.
    """
    keyed = roles.withColumn("key", portable_key(_plain_path(F.col("path"))))
    writer = F.col("role") != "input"
    owner = F.struct(F.when(writer, 1).otherwise(0).alias("rank"), "packet_id", "role", "path")
    groups = keyed.groupBy("key").agg(
        F.count(F.when(writer, 1)).alias("writers"), F.count(F.when(~writer, 1)).alias("readers"), F.min(owner).alias("owner")
    )
    clashing = groups.filter((F.col("writers") > 1) | ((F.col("writers") > 0) & (F.col("readers") > 0)))
    joined = keyed.filter(writer).join(clashing, "key")
    itself = (F.col("owner.packet_id") == F.col("packet_id")) & (F.col("owner.role") == F.col("role")) & (F.col("owner.path") == F.col("path"))
    code = (
        F.when((F.col("role") == "output") & (F.col("readers") > 0), "output_is_input")
        .when((F.col("role") == "report") & (F.col("readers") > 0), "report_is_input")
        .when((F.col("role") == "report"), "report_is_output")
        .otherwise("output_exists")
    )
    return joined.filter(~itself | (F.col("readers") > 0)).select(
        "packet_id", "role", "path", "key", F.col("owner.path").alias("owner_path"), code.alias("code")
    )
