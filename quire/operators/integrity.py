"""Consistency between tables: owners and indexes, references, snapshots, delivered sets, output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.scan import durable


def two_way_index(owners: DataFrame, index: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Bidirectional consistency of claims and index entries: (findings, repaired index).

    ``owners``: keys, element, claims (optional bool: the element names the key itself; without it all do); ``index``: keys,
    element, live.  A claim without an entry, a key claimed twice, an entry that names another
    element and an entry nobody refers to are findings.  An unclaimed stale entry to a live
    element is dropped with a warning; the repaired index holds the agreeing entries.
    """
    if "claims" in owners.columns:
        owners = owners.filter(F.coalesce("claims", F.lit(False)))
    # null keys meet nothing of the other side
    apart = lambda side: F.when(F.exists(F.array(*[F.col(key).isNull() for key in keys]), lambda null: null), F.lit(side)).alias("_apart")
    yes, no = F.lit(True), F.lit(False)
    rows = owners.select(*keys, apart(0), yes.alias("claims"), F.col("element").alias("claimed"), no.alias("lists"), F.lit(None).alias("listed"), F.lit(None).cast("boolean").alias("live"))
    rows = rows.unionByName(index.select(*keys, apart(1), no.alias("claims"), F.lit(None).alias("claimed"), yes.alias("lists"), F.col("element").alias("listed"), "live"))
    findings, repaired = index_faults(rows, [*keys, "_apart"])
    return findings.drop("_apart"), repaired.drop("_apart")


def index_faults(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """``two_way_index`` over one table whose rows may both claim a key and be an entry: (findings, repaired index).

    ``rows``: keys, claims and claimed (element), lists and listed (element), live.  Claims and entries of a key are
    combined in one aggregation; nothing is joined.
    """
    entry = F.col("lists")
    when = lambda side, value: F.when(F.col(side), F.col(value))
    both = rows.filter(F.col("claims") | entry).groupBy(*keys).agg(
        F.count(F.when(F.col("claims"), 1)).alias("_claims"), F.min(when("claims", "claimed")).alias("_owner"),
        F.count(F.when(entry, 1)).alias("_entries"), F.min(when("lists", "listed")).alias("_entry"),
        F.max(when("lists", "listed")).alias("_entry_other"), F.bool_or(when("lists", "live")).alias("_live"),
    )
    agrees = (F.col("_entry") == F.col("_owner")) & (F.col("_entry") == F.col("_entry_other"))
    fault = (
        F.when(F.col("_claims") > 1, "duplicate_claim")
        .when(F.col("_entries") == 0, "missing_entry")
        .when((F.col("_claims") == 0) & F.col("_live"), "stale_entry")
        .when(F.col("_claims") == 0, "unreferenced_entry")
        .when(~agrees, "disagreeing_entry")
    )
    code = F.when(fault == "stale_entry", "source_structure_index_normalized").otherwise("source_unsupported")
    marked = both.withColumn("fault", fault)
    findings = marked.filter("fault is not null").select(*keys, "fault", code.alias("code"))
    repaired = marked.filter("fault is null").select(*keys, F.col("_entry").alias("element"))
    return findings, repaired


def broken_references(refs: DataFrame, ids: DataFrame, roles: DataFrame, wanted: str) -> DataFrame:
    """Referenced ids that are missing, duplicated, or resolve to another role than ``wanted``.

    ``refs``: scope, ref, id; ``ids``: scope, id, role; ``roles``: name, terminal (resolved aliases).
    """
    counted = ids.groupBy("scope", "id").agg(F.count(F.lit(1)).alias("_copies"), F.min("role").alias("role"))
    resolved = counted.join(roles.select(F.col("name").alias("role"), "terminal"), "role", "left").withColumn(
        "_role", F.coalesce("terminal", "role")
    )
    joined = refs.join(resolved.select("scope", "id", "_copies", "_role"), ["scope", "id"], "left")
    fault = F.when(F.col("_copies").isNull(), "missing").when(F.col("_copies") > 1, "duplicate").when(F.col("_role") != wanted, "wrong_role")
    return joined.withColumn("fault", fault).filter("fault is not null").select("scope", "ref", "id", "fault")


def shared_owners(bindings: DataFrame, fitted: DataFrame) -> DataFrame:
    """Objects bound to several pages, flagged when one of those pages is transformed.

    ``bindings``: packet_id, object, page, declared_page (null = none); ``fitted``: packet_id,
    page, transform.  An owner page that is missing or conflicts is reported as well.
    """
    marked = bindings.join(fitted.select("packet_id", "page", "transform"), ["packet_id", "page"], "left")
    # min < max says "several pages" and combines before the shuffle
    owners = marked.groupBy("packet_id", "object").agg(
        F.min("page").alias("first_page"), F.max("page").alias("last_page"),
        F.bool_or(F.coalesce("transform", F.lit(False))).alias("transformed"),
        F.min("declared_page").alias("_low"), F.max("declared_page").alias("_high"),
    )
    several = F.col("first_page") < F.col("last_page")
    owner = (
        F.when(F.col("_low").isNull(), "missing")
        .when((F.col("_low") != F.col("_high")) | (F.col("_low") != F.col("first_page")), "conflicting").otherwise("agreed")
    )
    code = F.when(several & F.col("transformed"), "fit_annotation_ownership_unsupported").when(
        F.col("transformed") & (owner != "agreed"), "fit_form_unsupported"
    )
    return owners.select("packet_id", "object", several.alias("shared"), "transformed", owner.alias("owner"), code.alias("code"))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Same, changed, added or removed sources by content digest."""
    old = before.select("path", F.col("digest").alias("_old"), F.lit(True).alias("_was"))
    new = after.select("path", F.col("digest").alias("_new"), F.lit(True).alias("_is"))
    change = (
        F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "removed")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("changed")
    )
    return old.join(new, "path", "full_outer").select("path", change.alias("change"))


def affected_packets(diff: DataFrame, items: DataFrame) -> DataFrame:
    """Packets that use a changed, added or removed source and must be resolved again."""
    moved = diff.filter(F.col("change") != "same").select("path")
    return items.join(moved, "path", "left_semi").select("packet_id").distinct()


def expected_set(expected: DataFrame, listed: DataFrame, delivered: DataFrame) -> DataFrame:
    """Faults of a delivery: assets not listed, listed or delivered without being expected,
    not delivered, or delivered with another digest than listed."""
    name = lambda df: df.select("name").distinct()
    tag = lambda df, fault: df.select("name", F.lit(fault).alias("fault"))
    sums = listed.join(delivered.withColumnRenamed("digest", "_got"), "name").filter(~F.col("digest").eqNullSafe(F.col("_got")))
    return (
        tag(name(expected).exceptAll(name(listed)), "not_listed")
        .unionByName(tag(name(listed).exceptAll(name(expected)), "listed_unexpected"))
        .unionByName(tag(name(delivered).exceptAll(name(expected)), "delivered_unexpected"))
        .unionByName(tag(name(expected).intersect(name(listed)).exceptAll(name(delivered)), "not_delivered"))
        .unionByName(tag(sums, "digest_mismatch"))
    )


def verify_pages(expected: DataFrame, actual: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Findings of a written packet against its page map.

    ``expected``: packet_id, page, text, width, height; ``actual`` adds ``object``.  Checks the
    page count, text order, reuse of page objects and geometry within ``tolerance``.
    """
    want = expected.select("packet_id", "page", F.col("text").alias("_t"), F.col("width").alias("_w"), F.col("height").alias("_h"), F.lit(1).alias("_want"))
    got = actual.select("packet_id", "page", "text", "width", "height", F.lit(1).alias("_got"))
    both = want.join(got, ["packet_id", "page"], "full_outer")
    # a side that is expected but not written is off as well
    apart = lambda want, got: F.col(want).isNotNull() & F.coalesce(F.abs(F.col(want) - F.col(got)) > tolerance, F.lit(True))
    off = apart("_w", "width") | apart("_h", "height")
    check = (
        F.when(F.col("_got").isNull(), "missing_page").when(F.col("_want").isNull(), "extra_page")
        .when(~F.col("_t").eqNullSafe(F.col("text")), "page_text").when(off, "geometry")
    )
    pages = both.select("packet_id", "page", check.alias("check")).filter("check is not null")
    reused = actual.groupBy("packet_id", "object").agg(F.count(F.lit(1)).alias("_n"), F.min("page").alias("page")).filter("_n > 1")
    return pages.unionByName(reused.select("packet_id", "page", F.lit("reused_page").alias("check")))


def verify_versions(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Packets written in a lower version than their sources need."""
    need = expected.select("packet_id", F.col("version").alias("needed"))
    return actual.join(need, "packet_id").filter(F.col("version") < F.col("needed")).select("packet_id", "version", "needed")


def verify_links(page_map: DataFrame, links: DataFrame) -> DataFrame:
    """Links that end nowhere, in another occurrence, or at the wrong source page.

    ``page_map``: packet_id, output_page, occurrence, source_page; ``links``: packet_id,
    from_page, to_page, wanted_page (null = any).
    """
    place = lambda name, prefix: page_map.select(
        "packet_id", F.col("output_page").alias(name), F.col("occurrence").alias(f"{prefix}_occurrence"), F.col("source_page").alias(f"{prefix}_source_page")
    )
    traced = links.join(place("from_page", "_from"), ["packet_id", "from_page"]).join(place("to_page", "_to"), ["packet_id", "to_page"], "left")
    check = (
        F.when(F.col("_to_occurrence").isNull(), "dangling")
        .when(F.col("_to_occurrence") != F.col("_from_occurrence"), "crossed")
        .when(F.col("wanted_page").isNotNull() & (F.col("_to_source_page") != F.col("wanted_page")), "wrong_page")
    )
    return traced.select("packet_id", "from_page", "to_page", check.alias("check")).filter("check is not null")


def canonical(column: Column, kind: T.DataType) -> Column:
    """The same value with map entries and struct fields in name order, at every level."""
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(column), lambda e: F.struct(e["key"].alias("key"), canonical(e["value"], kind.valueType).alias("value")))
        return F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(column.isNotNull(), F.struct(*[canonical(column[f.name], f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda e: canonical(e, kind.elementType))
    return column


def canonical_digest(df: DataFrame, columns: list[str], out: str = "digest") -> DataFrame:
    """Order-independent digest of nested values: equal content gives an equal digest."""
    value = F.struct(*[canonical(F.col(c), df.schema[c].dataType).alias(c) for c in sorted(columns)])
    return df.withColumn(out, F.sha2(F.to_json(value, {"ignoreNullFields": "false"}).cast("binary"), 256))


def tag_text(number: Column, letters: int = 6) -> Column:
    """A number as upper-case letters in base 26, padded to ``letters``."""
    digit = lambda place: F.chr((F.floor(number / (26**place)) % 26 + 65).cast("bigint"))
    return F.concat(*[digit(place) for place in range(letters - 1, -1, -1)])


def tag_number(text: Column, letters: int = 6) -> Column:
    """The number behind a six-letter tag; null for anything else."""
    total = F.lit(0).cast("bigint")
    for i in range(letters):
        total = total * 26 + F.ascii(F.substring(text, i + 1, 1)) - 65
    return F.when(text.rlike(f"^[A-Z]{{{letters}}}$"), total)


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Number all rows 1, 2, ... in a unique ``order``, without a group that holds them all.

    Rows are sorted by range; the driver sees the row count of every range only.  The written table pins the ranges.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    stamped = durable(ranged.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}))
    counts = stamped.groupBy("_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows")).orderBy("_part").collect()
    starts, before = [], 0
    for r in counts:
        starts.append((r["_part"], before - r["_first"] + 1))
        before += r["_rows"]
    shifts = df.sparkSession.createDataFrame(starts, "_part int, _shift bigint")
    return stamped.join(F.broadcast(shifts), "_part").select(*df.columns, (F.col("_row") + F.col("_shift")).alias(out))


def assign_tags(wanted: DataFrame, reserved: DataFrame) -> DataFrame:
    """Sorted identities take the next free tags, skipping reserved ones.

    The i-th free number is i plus the reserved numbers before it.  A reserved number r with
    j reserved ones below it lies before free number i exactly when r - j <= i, so both ordered lists are
    merged, and the place of an identity in the merged list, counted from 0, is its number.
    """
    taken = reserved.select(tag_number(F.col("tag")).alias("number")).filter("number is not null").distinct()
    marks = numbered(taken, ["number"], "j").select((F.col("number") - F.col("j") + 1).alias("at"), F.lit(0).alias("side"), F.col("number").cast("string").alias("identity"))
    asks = numbered(wanted.select("identity").distinct(), ["identity"], "i").select((F.col("i") - 1).alias("at"), F.lit(1).alias("side"), "identity")
    merged = numbered(marks.unionByName(asks), ["at", "side", "identity"], "line")
    return merged.filter("side = 1").select("identity", tag_text(F.col("line") - 1).alias("tag"))
