"""Where every part of a packet lands: padding, placement, numbering, sections, contents.

Tables share ``packet_id`` and the order columns ``pos`` (item) and ``band`` (0 for the blank
inserted before an item, 1 for the item itself).  ``split`` is passed through to ``scan``.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quire.functions.limits import MAX_PAGE_INDEX, MAX_SIDE_POINTS, NUMBERED_KINDS, UNNUMBERED_LABEL
from quire.operators.scan import (
    CarryLast, GroupFirst, RunningSum, durable, exceeds_group_limit, group_limit, islands,
    scan, spread,
)

PACKET = ["packet_id"]
PLACE = ["pos", "band"]


def pad_odd_starts(events: DataFrame, keep: tuple = (), split: bool | None = None) -> DataFrame:
    """Insert one blank before every ``odd`` row that would otherwise start on an even page.

    After an odd boundary the running count is even whether or not a blank was added, so a
    boundary needs a blank exactly when the unpadded counts at this boundary and the one
    before differ in parity.  ``keep`` names item columns the blank inherits.
    """
    if split is None:
        split = exceeds_group_limit(events, PACKET)
    counted = scan(events, PACKET, ["pos"], [RunningSum("_before", F.col("pages"), inclusive=False)], split)
    parity = F.when(F.col("odd"), F.col("_before") % 2)
    looked = scan(counted, PACKET, ["pos"], [CarryLast("_parity", parity)], split)
    padded = F.col("odd") & (F.col("_before") % 2 != F.coalesce("_parity", F.lit(0)))
    both = looked.withColumn("band", F.explode(F.when(padded, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))
    blank = F.col("band") == 0
    kept = {"packet_id", "pos", "ref", *keep}
    columns = []
    for name in events.columns:
        column = F.col(name)
        if name == "kind":
            column = F.when(blank, "padding").otherwise(column)
        elif name == "pages":
            column = F.when(blank, F.lit(1)).otherwise(column)
        elif name == "odd":
            column = ~blank & column
        elif name not in kept:
            column = F.when(~blank, column)
        columns.append(column.alias(name))
    return both.select(*columns, "band")


def place_parts(events: DataFrame, split: bool | None = None) -> DataFrame:
    """First and last output page of every part; rows without pages take none."""
    placed = scan(events, PACKET, PLACE, [RunningSum("_before", F.col("pages"), inclusive=False)], split)
    return placed.select(
        *events.columns,
        (F.col("_before") + 1).cast("bigint").alias("first_page"),
        (F.col("_before") + F.col("pages")).cast("bigint").alias("last_page"),
    )


def inherit_sizes(events: DataFrame, fit: tuple[float, float, float] | None = None, split: bool | None = None):
    """Size of every generated part and of every blank.

    Own size, else the fit target, else the last page of the nearest earlier source, else the
    first page of the packet's first source.  A blank takes the sheet physically before it.
    Expects ``first_w/first_h/last_w/last_h`` on source rows and ``width/height`` (null =
    inherit) on generated rows; returns (sized, findings).
    """
    if split is None:
        split = exceeds_group_limit(events, PACKET)
    is_source, is_blank = F.col("kind") == "source", F.col("kind") == "padding"
    box = lambda w, h: F.struct(w.alias("w"), h.alias("h"))
    last = F.when(is_source, box(F.col("last_w"), F.col("last_h")))
    first = F.when(is_source, box(F.col("first_w"), F.col("first_h")))
    near = scan(events, PACKET, PLACE, [CarryLast("_near", last), GroupFirst("_first", first)], split)
    own = F.when(F.col("width").isNotNull() & ~is_source, box(F.col("width"), F.col("height")))
    target = [box(F.lit(fit[0]), F.lit(fit[1]))] if fit else []
    size = F.when(is_source, last).when(~is_blank, F.coalesce(own, *target, F.col("_near"), F.col("_first")))
    sized = near.withColumn("_size", size)
    sheet = F.col("_size")
    if fit:
        outside = F.greatest(
            *[(~F.col(f"_size.{side}").between(F.lit(goal - fit[2]), F.lit(goal + fit[2]))).cast("int")
              for side, goal in (("w", fit[0]), ("h", fit[1]))]
        )
        sheet = F.when(F.col("_size").isNull(), F.lit(None)).when(outside == 1, target[0]).otherwise(F.col("_size"))
    sized = sized.withColumn("_sheet", sheet)
    sized = scan(sized, PACKET, PLACE, [CarryLast("_under", F.col("_sheet"))], split)
    final = F.when(is_blank, F.col("_under")).otherwise(F.col("_size"))
    output = F.when(is_blank, F.col("_under")).otherwise(F.col("_sheet"))
    result = sized.withColumn("_final", final).withColumn("_output", output).select(
        *events.columns,
        F.col("_final.w").alias("size_w"), F.col("_final.h").alias("size_h"),
        F.col("_output.w").alias("output_w"), F.col("_output.h").alias("output_h"),
    )
    code = (
        F.when(F.col("size_w").isNull(), "page_size_required")
        .when(~((F.col("size_w") >= 1) & (F.col("size_h") >= 1)), "plan_value")
        .when((F.col("size_w") > MAX_SIDE_POINTS) | (F.col("size_h") > MAX_SIDE_POINTS), "page_size_too_large")
    )
    findings = result.filter(~is_source).select("packet_id", "pos", "band", code.alias("code")).filter("code is not null")
    return result, findings


def section_spans(sections: DataFrame, parts: DataFrame) -> DataFrame:
    """First page, last page and target of every section.

    ``parts.section_path`` lists the enclosing sections.  A blank inserted for a group lies
    in the parent's path, so plain minima and maxima give the ranges; blanks are no target.
    """
    inside = parts.filter(F.col("pages") > 0).select(
        "packet_id", "kind", "first_page", "last_page", F.explode("section_path").alias("section")
    )
    spans = inside.groupBy("packet_id", "section").agg(
        F.min("first_page").alias("first_page"),
        F.max("last_page").alias("last_page"),
        F.min(F.when(F.col("kind") != "padding", F.col("first_page"))).alias("target"),
    )
    return sections.join(spans, ["packet_id", "section"], "left")


def page_totals(parts: DataFrame) -> DataFrame:
    """Source, generated and total pages; null while any part of the sum is unknown."""
    pages, source = F.col("pages"), F.col("kind") == "source"
    known = lambda rows: F.count(F.when(rows & pages.isNull(), 1)) == 0
    total = lambda rows: F.when(known(rows), F.coalesce(F.sum(F.when(rows, pages)), F.lit(0)))
    every = F.lit(True)
    return parts.groupBy("packet_id").agg(
        total(source).alias("source_pages"), total(~source).alias("generated_pages"), total(every).alias("total_pages")
    )


def drop_failed(table: DataFrame, findings: DataFrame) -> DataFrame:
    """All or nothing: a packet with an error finding keeps no rows."""
    failed = findings.filter(F.col("severity") == "error").select("packet_id").distinct()
    return table.join(failed, "packet_id", "left_anti")


def eligible(kinds: Column | None = None) -> Column:
    """Whether a part takes a number: switched on, kind chosen (null = all), never a blank."""
    chosen = F.col("enabled") & F.col("kind").isin(NUMBERED_KINDS)
    return chosen if kinds is None else chosen & (kinds.isNull() | F.coalesce(F.array_contains(kinds, F.col("kind")), F.lit(False)))


def label_pages(parts: DataFrame, kinds: Column | None = None, split: bool | None = None) -> DataFrame:
    """First label of every part.  ``mode`` null means no numbering policy: labels are page numbers."""
    counts = F.when(eligible(kinds), F.col("pages")).otherwise(0)
    counted = scan(parts, PACKET, PLACE, [RunningSum("_numbered", counts, inclusive=False)], split)
    start = F.coalesce(F.col("start"), F.lit(1))
    number = F.when(F.col("mode") == "physical", start + F.col("first_page") - 1).otherwise(start + F.col("_numbered"))
    label_start = F.when(F.col("mode").isNull(), F.col("first_page")).when(eligible(kinds), number)
    return counted.select(*parts.columns, label_start.cast("bigint").alias("label_start"))


def label_at(page: Column, first_page: Column, label_start: Column) -> Column:
    """The printed label of one page of a part."""
    return F.coalesce((label_start + page - first_page).cast("string"), F.lit(UNNUMBERED_LABEL))


def label_spans(parts: DataFrame, split: bool | None = None) -> DataFrame:
    """Merge neighbours that are both unnumbered or continue one count."""
    shift = F.col("label_start") - F.col("first_page")
    runs = islands(
        parts.filter(F.col("pages") > 0), PACKET, PLACE, {"shift": shift, "last_page": F.col("last_page")},
        lambda prev: ~prev["shift"].eqNullSafe(shift) | (prev["last_page"] + 1 != F.col("first_page")), split=split,
    )
    return runs.groupBy("packet_id", "island").agg(
        F.min("first_page").alias("first_page"), F.max("last_page").alias("last_page"),
        F.min("label_start").alias("label_start"),
    )


def label_overflow(parts: DataFrame, maximum: int = MAX_PAGE_INDEX, kinds: Column | None = None, split: bool | None = None):
    """First page whose label passes ``maximum`` and the largest start that still works."""
    wide = lambda c: c.cast("decimal(38,0)")
    chosen = eligible(kinds) & F.col("mode").isNotNull()
    counts = F.when(chosen, F.col("pages")).otherwise(0)
    counted = scan(parts, PACKET, PLACE, [RunningSum("_numbered", counts, inclusive=False)], split)
    physical = F.col("mode") == "physical"
    offset = wide(F.when(physical, F.col("first_page") - 1).otherwise(F.col("_numbered")))
    room = F.lit(maximum).cast("decimal(38,0)") - wide(F.coalesce(F.col("start"), F.lit(1)))
    over = chosen & (offset + wide(F.col("pages")) - 1 > room)
    first_bad = wide(F.col("first_page")) + F.greatest(wide(F.lit(0)), room + 1 - offset)
    last = F.max(F.when(chosen, F.col("last_page")))
    numbered = F.sum(counts)
    return (
        counted.groupBy("packet_id")
        .agg(
            F.min(F.when(over, first_bad)).cast("bigint").alias("page"),
            (F.lit(maximum) - (F.when(F.first("mode") == "consecutive", numbered).otherwise(last) - 1)).cast("bigint").alias("largest_start"),
        )
        .filter(F.col("page").isNotNull())
    )


def label_width_bound(parts: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """Digits to reserve for labels, from a bound that no later step can pass.

    The bound adds every page, every section, every possible blank and the start offset, so
    the width never depends on where sections finally land.  ``parts`` are unpadded.
    """
    eligible_any = F.max(F.when(eligible(), 1).otherwise(0)) == 1
    mode = F.first("mode")
    start = F.when(mode.isNotNull(), F.coalesce(F.first("start"), F.lit(1)) - 1).otherwise(0)
    bound = F.sum("pages") + F.sum(F.col("odd").cast("bigint")) + start
    totals = parts.groupBy("packet_id").agg(bound.alias("_bound"), (mode.isNull() | eligible_any).alias("_any"))
    extra = F.lit(0)
    if sections is not None:
        counted = sections.groupBy("packet_id").agg(F.count(F.lit(1)).alias("_sections"))
        totals = totals.join(counted, "packet_id", "left")
        extra = F.coalesce(F.col("_sections"), F.lit(0))
    width = F.when(F.col("_any"), F.length(F.greatest(F.col("_bound") + extra, F.lit(1)).cast("string"))).otherwise(0)
    return totals.select("packet_id", (F.col("_bound") + extra).alias("bound"), width.cast("bigint").alias("digits"))


def contents_rows(sections: DataFrame, labelled: DataFrame) -> DataFrame:
    """One contents line per section: title, indent, link target and the target's label.

    A target is the first page of a part, so its label is found by equality, not by range.
    """
    starts = labelled.filter((F.col("pages") > 0) & (F.col("kind") != "padding")).select(
        "packet_id", F.col("first_page").alias("target"), F.coalesce(F.col("label_start").cast("string"), F.lit(UNNUMBERED_LABEL)).alias("label")
    )
    return sections.join(starts, ["packet_id", "target"], "left").select(
        "packet_id", "section", "title", (12 * F.col("depth")).alias("indent"), "target", "label", *[c for c in ("pos",) if c in sections.columns]
    )


#: Rows of a packet that one transfer function sums up.
FILL_ROWS = 4096


def paginate_rows(rows: DataFrame, usable: int, gap: int) -> tuple[DataFrame, DataFrame]:
    """Fill pages with whole rows in order; a row too tall for an empty page is rejected.

    Rows carry integral ``height``.  They are sorted by range and filled in one pass: a packet inside a range is
    settled there.  One that goes on elsewhere is cut into chunks with a transfer function each: by how full the page is at its
    first row, the pages a chunk opens and how full it leaves the last one.  Only these functions are followed along the packet,
    and then every chunk is filled from its known start.  Returns (placed, rejected).
    """
    rejected = rows.filter(F.col("height") > usable)
    whole = rows.join(rejected.select("packet_id").distinct(), "packet_id", "left_anti")
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("packet_id", "pos")}
    most = min(FILL_ROWS, group_limit(rows.sparkSession))
    ordered = whole.repartitionByRange("packet_id", "pos").sortWithinPartitions("packet_id", "pos")
    light = ordered.select("packet_id", "pos", F.col("height").cast("bigint").alias("height"), F.monotonically_increasing_id().alias("_at"))
    packed = f"packet_id {kinds['packet_id']}, chunk bigint, pos array<{kinds['pos']}>, height array<bigint>"
    first = _arrow(f"{packed}, page array<bigint>, most array<bigint>, pages array<bigint>, used array<bigint>")
    filled = durable(light.mapInArrow(lambda batches: _fill_range(batches, usable, gap, most, first[1]), first[0]))
    steps = filled.filter(F.col("page").isNull()).select("packet_id", "chunk", "most", "pages", "used")
    known = _arrow("chunk bigint, _page bigint, _used bigint")
    starts = steps.repartition("packet_id").sortWithinPartitions("packet_id", "chunk").mapInArrow(lambda batches: _follow(batches, known[1]), known[0])
    last = _arrow(f"packet_id {kinds['packet_id']}, pos array<{kinds['pos']}>, height array<bigint>, page array<bigint>")
    rest = filled.filter(F.col("page").isNull()).select("packet_id", "chunk", "pos", "height").join(starts, "chunk")
    rest = rest.mapInArrow(lambda batches: _fill_chunks(batches, usable, gap, last[1]), last[0])
    done = filled.filter(F.col("page").isNotNull()).select("packet_id", "pos", "height", "page").unionByName(rest)
    flat = done.select("packet_id", F.explode(F.arrays_zip("pos", "height", "page")).alias("r"))
    return flat.select("packet_id", "r.pos", "r.height", "r.page"), rejected


def _arrow(schema: str) -> tuple[StructType, pa.Schema]:
    kind = StructType.fromDDL(schema)
    return kind, to_arrow_schema(kind)


def _fill(heights: list[int], usable: int, gap: int, page: int = 0, used: int = 0) -> list[int]:
    """Page of every row, from a page filled up to ``used`` (page 0: none yet)."""
    pages = []
    for height in heights:
        if not page or used + height > usable:
            page, used = page + 1, 0
        used += height + gap
        pages.append(page)
    return pages


def _transfer(heights: list[int], usable: int, gap: int) -> dict:
    """``most[k]``: how full the first page may be at most so that k rows still go there; with them, the ``pages`` opened
    after it and how full the last one is (``used``; where no page is opened, what the rows add to the first)."""
    n = len(heights)
    tops = [0]
    for height in heights:
        tops.append(tops[-1] + height + gap)
    opened, left, stop = [0] * (n + 1), [0] * (n + 1), n
    for k in range(n - 1, -1, -1):  # a page that starts with row k ends before row ``stop``
        while tops[stop - 1] + heights[stop - 1] - tops[k] > usable:
            stop -= 1
        opened[k], left[k] = (opened[stop] + 1, left[stop]) if stop < n else (1, tops[n] - tops[k])
    most, k = [usable + gap], 0
    while k < n and tops[k] + heights[k] <= usable:
        most.append(usable - tops[k] - heights[k])
        k += 1
    return {"most": most, "pages": [opened[j] for j in range(len(most))], "used": [left[j] if j < n else tops[n] for j in range(len(most))]}


def _fill_range(batches: Iterator[pa.RecordBatch], usable: int, gap: int, most: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Filled packets, and chunks with transfer functions of the first and last packet and of those over ``most`` rows."""
    packet, opened, first, cut, rows, out = None, False, True, False, [], []

    def piece(settled: bool) -> dict:
        ats, positions, heights = zip(*rows)
        facts = {"page": _fill(heights, usable, gap)} if settled else _transfer(heights, usable, gap)
        return {"packet_id": packet, "chunk": ats[0], "pos": positions, "height": heights, **facts}

    for batch in batches:
        for own, *row in zip(*[batch.column(c).to_pylist() for c in ("packet_id", "_at", "pos", "height")]):
            if opened and own != packet:
                out.append(piece(not first and not cut))
                first, cut, rows = False, False, []
            elif len(rows) >= most:
                out.append(piece(False))
                cut, rows = True, []
            packet, opened = own, True
            rows.append(row)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if rows:
        yield pa.RecordBatch.from_pylist([piece(False)], schema)


def _follow(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Page and fill before every chunk, from the chunks' transfer functions in order."""
    packet, page, used = None, 0, 0
    for batch in batches:
        found = []
        for row in batch.to_pylist():
            if row["packet_id"] != packet:
                packet, page, used = row["packet_id"], 0, 0
            found.append({"chunk": row["chunk"], "_page": page, "_used": used})
            # rows that still go to the open page; none is open before the first row
            k = bisect_right(row["most"], -used, key=lambda m: -m) - 1 if page else 0
            if row["pages"][k]:
                page, used = page + row["pages"][k], row["used"][k]
            else:
                used += row["used"][k]
        yield pa.RecordBatch.from_pylist(found, schema)


def _fill_chunks(batches: Iterator[pa.RecordBatch], usable: int, gap: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            pages = _fill(row["height"], usable, gap, row["_page"], row["_used"])
            yield pa.RecordBatch.from_pylist([{"packet_id": row["packet_id"], "pos": row["pos"], "height": row["height"], "page": pages}], schema)


def _compact(parts: DataFrame) -> DataFrame:
    """Output spans ``_first`` to ``_last`` of placed parts, with the source page ``_src`` of the first one."""
    key = ["packet_id", "pos", "band"]
    kept = [c for c in parts.columns if c != "ranges"]
    whole = F.array(F.struct(F.when(F.col("kind") == "source", F.lit(1)).cast("bigint").alias("first"),
                             F.when(F.col("kind") == "source", F.col("pages")).cast("bigint").alias("last")))
    rows = parts.filter(F.col("pages") > 0).select(*kept, F.posexplode(F.coalesce("ranges", whole)).alias("_ordinal", "_r"))
    length = F.coalesce(F.col("_r.last") - F.col("_r.first") + 1, F.col("pages"))
    # a group is the array of one row, so it fits a task
    offset = scan(rows, key, ["_ordinal"], [RunningSum("_offset", length, inclusive=False)], False)
    start = F.col("first_page") + F.col("_offset")
    return offset.select(*kept, F.col("_r.first").alias("_src"), start.alias("_first"), (start + length - 1).alias("_last"))


def page_map(parts: DataFrame, keep: tuple = ()) -> DataFrame:
    """The trace table: one row per output page with its part, source page and label; ``keep`` names further columns of the part.

    ``parts`` are placed, labelled and carry their ``ranges`` (null = the whole source).  The
    ranges are unnested inside the packet's partition and pages appear in the last step only,
    so the one shuffle by packet is followed by nothing but the spread of compact spans.
    """
    from quire.operators.ranges import expand_spans

    pages = expand_spans(_compact(parts), "_first", "_last", "output_page", ["packet_id", "pos", "band"])
    return pages.select(
        "packet_id", "output_page", "pos", "band", "kind", *[c for c in ("path", "ref") if c in parts.columns],
        (F.col("_src") + F.col("output_page") - F.col("_first")).alias("source_page"),
        label_at(F.col("output_page"), F.col("first_page"), F.col("label_start")).alias("label"), *keep,
    )


def _cut_by_size(spans: DataFrame, runs: DataFrame, tasks: int | None = None) -> DataFrame:
    """Spans cut where the size of their source changes, with that size; ``runs``: path, first, last, width, height.

    Both are cut where blocks of ``SELECT_BLOCK`` source pages end and meet by path and block, over ``tasks`` tasks, so a long source
    spreads over its blocks. Spans without a source are cut to ``EXPAND_CHUNK`` pages and lie anywhere. Pages that no run covers stay,
    without a size.
    """
    from quire.operators.ranges import EXPAND_CHUNK, SELECT_BLOCK, block_of

    start, stop = F.col("_of") * SELECT_BLOCK + 1, (F.col("_of") + 1) * SELECT_BLOCK
    blocks = lambda first, last: F.explode(F.sequence(block_of(first), block_of(last)))
    known = runs.select("path", "first", "last", "width", "height", blocks(F.col("first"), F.col("last")).alias("_of"))
    known = spread(known, tasks, "path", "_of").withColumns({"first": F.greatest("first", start), "last": F.least("last", stop)})
    order = Window.partitionBy("path", "_of").orderBy("first")
    looked = known.withColumns({"_before": F.coalesce(F.lag("last").over(order) + 1, start), "_after": F.lead("first").over(order)})
    run = lambda first, last, *size: F.struct(first.cast("bigint").alias("first"), last.cast("bigint").alias("last"), *[c.cast("double").alias(n) for c, n in zip(size, ("width", "height"))])
    hole = F.when(F.col("_before") < F.col("first"), run(F.col("_before"), F.col("first") - 1, F.lit(None), F.lit(None)))
    rest = F.when(F.col("_after").isNull() & (F.col("last") < stop), run(F.col("last") + 1, stop, F.lit(None), F.lit(None)))
    each = F.filter(F.array(hole, run(*[F.col(c) for c in ("first", "last", "width", "height")]), rest), lambda r: r.isNotNull())
    cover = looked.select("path", "_of", F.explode(each).alias("r")).select("path", "_of", "r.*")
    # sorted, as what exploded pages amount to cannot be told from the files they come from
    whole = cover.select(*[F.col(c).alias(f"_run_{c}") for c in cover.columns]).hint("merge")

    sourced, length = F.col("path").isNotNull() & F.col("_src").isNotNull(), F.col("_last") - F.col("_first")
    pieces = F.when(sourced, F.sequence(block_of(F.col("_src")), block_of(F.col("_src") + length))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.floor(length / EXPAND_CHUNK)))
    cut = spans.filter(F.col("_last") >= F.col("_first")).withColumn("_of", F.explode(pieces))
    low = F.when(sourced, F.greatest(start - F.col("_src"), F.lit(0))).otherwise(F.col("_of") * EXPAND_CHUNK)
    high = F.least(length, F.when(sourced, stop - F.col("_src")).otherwise((F.col("_of") + 1) * EXPAND_CHUNK - 1))
    moved = {"_src": F.col("_src") + low, "_first": F.col("_first") + low, "_last": F.col("_first") + high}
    cut = cut.select(*[c for c in spans.columns if c not in moved], *[v.alias(c) for c, v in moved.items()])

    anywhere = F.xxhash64(*[c for c in ("packet_id", "pos", "band") if c in spans.columns], "_first")
    at, end = F.when(sourced, block_of(F.col("_src"))).otherwise(anywhere), F.col("_src") + F.col("_last") - F.col("_first")
    meets = (F.col("path") == F.col("_run_path")) & (at == F.col("_run__of")) & (F.col("_run_first") <= end) & (F.col("_run_last") >= F.col("_src"))
    joined = cut.join(whole, meets, "left")
    begin, until = F.greatest("_src", "_run_first"), F.least(end, F.col("_run_last"))
    shifted = {"_first": F.coalesce(F.col("_first") + begin - F.col("_src"), F.col("_first")), "_last": F.coalesce(F.col("_first") + until - F.col("_src"), F.col("_last")), "_src": F.when(F.col("_run_path").isNull(), F.col("_src")).otherwise(begin)}
    return joined.select(*[c for c in spans.columns if c not in shifted], *[v.alias(c) for c, v in shifted.items()], "_run_width", "_run_height")


def page_trace(parts: DataFrame, runs: DataFrame, sections: DataFrame, levels: int, split: bool | None = None, tasks: int | None = None) -> DataFrame:
    """The wide trace table: ``page_map`` with the occurrence of the source, the size and the innermost section.

    ``parts`` additionally carry ``occurrence`` (the n-th use of the path, null without one) and the ``width`` and
    ``height`` of generated pages.  ``runs`` hold the sizes of sources (see ``page_runs``), ``sections`` the spans
    (section, depth, first_page, last_page) of nested sections that are made of whole parts, ``levels`` deep at most.
    Sections are found for parts and sizes for compact spans, which are dealt over ``tasks`` tasks; pages appear in the last step only.
    """
    from quire.operators.ranges import innermost_at

    # a section holds whole parts, so it is found once per part and not for every cut of it
    within = innermost_at(parts.filter(F.col("pages") > 0), sections, PACKET, "first_page", "first_page", "last_page", "depth", ["section"], levels, split)
    # their cuts are short and spread by source and block already
    pages = _cut_by_size(_compact(within), runs, tasks).withColumn("output_page", F.explode(F.sequence("_first", "_last")))
    source = F.col("kind") == "source"
    return pages.select(
        "packet_id", "output_page", "pos", "band", "kind", "path", "occurrence",
        (F.col("_src") + F.col("output_page") - F.col("_first")).alias("source_page"),
        label_at(F.col("output_page"), F.col("first_page"), F.col("label_start")).alias("label"),
        *[F.when(source, F.col(f"_run_{c}")).when(F.col("kind") != "padding", F.col(c)).alias(c) for c in ("width", "height")], "section",
    )
