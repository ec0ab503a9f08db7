"""What each member of a manifest may be: tables of members with rules, turned into column expressions.

A rule takes the variant of a member that is written (``null`` counts as written) and gives the code of its
fault, or null. An object's rule looks at the object itself, then for unknown members, then at its members
in the order of the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.limits import (
    MANIFEST_VERSION, MAX_FIELD_CHARACTERS, MAX_GENERATED_PAGES, MAX_RANGE_PAIRS, MAX_SIDE_POINTS, MAX_TIMESTAMP,
)
from quire.functions.rules import FORBIDDEN_XML, LENGTH, NOT_SINGLE_LINE, VISIBLE, language_ok, parse_size, parse_tolerance, unit_factor

Rule = Callable[[Column], Column]

# Fixed values of the manifest format.
STRUCTURES = ["preserve", "discard"]
START_ON = ["any", "odd"]
NUMBER_MODES = ["physical", "consecutive"]
NUMBER_POSITIONS = ["top-left", "top-center", "top-right", "bottom-left", "bottom-center", "bottom-right"]
NUMBER_KINDS = ["source", "page", "divider", "contents"]
ANCHORS = ["top-left", "top", "top-right", "left", "center", "right", "bottom-left", "bottom", "bottom-right"]
ALIGNMENTS = ["left", "center", "right", "justify"]
WRAPS = ["word", "emergency"]
OVERFLOWS = ["error", "allow"]
COLOR = r"^#([0-9a-fA-F]{3}|[0-9a-fA-F]{6})$"
LEADING = (1.0, 10.0)

NUMBERS = r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)"


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def get(value: Column, type: str, path: str = "$") -> Column:
    return F.try_variant_get(value, path, type)


def member(value: Column, name: str) -> Column:
    return get(value, "variant", f"$['{name}']")


def keys(value: Column) -> Column:
    """Names of an object's members; null for anything else."""
    return F.map_keys(get(value, "map<string,variant>"))


def typed(pattern: str, *checks: Rule) -> Rule:
    """``null`` is not allowed, the type must match, and then the checks must pass."""
    return lambda v: F.coalesce(
        F.when(kind(v) == "VOID", "plan_null"), F.when(~kind(v).rlike(pattern), "plan_type"), *[check(v) for check in checks]
    )


def string(*checks: Rule) -> Rule:
    return typed("^STRING$", *[lambda v, c=check: c(get(v, "string")) for check in checks])


def fails(condition: Rule, code: str = "plan_value") -> Rule:
    return lambda v: F.when(condition(v), code)


def one_of(values: list[str]) -> Rule:
    return string(fails(lambda s: ~s.isin(values)))


too_long = fails(lambda s: F.length(s) > MAX_FIELD_CHARACTERS, "plan_limit")
path = string(fails(lambda s: (s == "") | s.contains("\x00"), "path_invalid"))
title = string(too_long, fails(lambda s: s.rlike(NOT_SINGLE_LINE) | ~s.rlike(VISIBLE)))
described = string(fails(lambda s: s.rlike(FORBIDDEN_XML) | (F.length(s) > MAX_FIELD_CHARACTERS)))
language = string(fails(lambda s: s.rlike(FORBIDDEN_XML) | (F.length(s) > MAX_FIELD_CHARACTERS) | ~language_ok(s)))
color = string(fails(lambda s: ~s.rlike(COLOR)))
fill = string(fails(lambda s: (s != "none") & ~s.rlike(COLOR)))
flag = typed("^BOOLEAN$")


def size(inherit: bool) -> Rule:
    wrong = lambda s: parse_size(s)["reject"].isNotNull() | (F.lit(not inherit) & (s == "inherit"))
    return string(fails(wrong))


def whole(least: int, most: int | None = None) -> Rule:
    """A 64-bit integer; other numbers are of the wrong type."""
    outside = lambda v: (get(v, "bigint") < least) | (F.lit(False) if most is None else get(v, "bigint") > most)
    return typed("^BIGINT$", fails(outside))


def number(least: float, most: float) -> Rule:
    """A finite number within bounds."""
    inside = lambda v: F.coalesce(get(v, "double").between(least, most), F.lit(False))
    return typed(NUMBERS, fails(lambda v: ~inside(v)))


def points(text: Column) -> Column:
    """Points of an authored length; null if it is none."""
    value = F.regexp_extract(text, LENGTH, 1).try_cast("double") * unit_factor(F.regexp_extract(text, LENGTH, 2))
    return F.when(text.rlike(LENGTH), value)


def length(least: float) -> Rule:
    """Points as a number, or a text with a unit."""
    value = lambda v: F.when(kind(v) == "STRING", points(get(v, "string"))).otherwise(get(v, "double"))
    return typed(r"^(STRING|BIGINT|DECIMAL|DOUBLE|FLOAT)", fails(lambda v: ~F.coalesce(value(v).between(least, MAX_SIDE_POINTS), F.lit(False))))


def tolerance(v: Column) -> Column:
    inside = F.when(kind(v) == "STRING", parse_tolerance(get(v, "string")).isNotNull()).otherwise(get(v, "double").between(0.0, MAX_SIDE_POINTS))
    return typed(r"^(STRING|BIGINT|DECIMAL|DOUBLE|FLOAT)", fails(lambda _: ~F.coalesce(inside, F.lit(False))))(v)


def version(v: Column) -> Column:
    return F.coalesce(typed(NUMBERS)(v), F.when((kind(v) != "BIGINT") | (get(v, "bigint") != MANIFEST_VERSION), "plan_version_unsupported"))


def count(v: Column) -> Column:
    """An integer token from 1; integers beyond the limit, of any length, exceed it."""
    beyond = kind(v).rlike(r"^DECIMAL\([0-9]+,0\)") & (F.abs(get(v, "double")) >= 2.0**63)
    return typed(NUMBERS, lambda v: F.when(beyond | (get(v, "bigint") > MAX_GENERATED_PAGES) & (kind(v) == "BIGINT"), "plan_limit").when(
        (kind(v) != "BIGINT") | (get(v, "bigint") < 1), "plan_value"))(v)


def page_index(v: Column) -> Column:
    return F.coalesce(typed(NUMBERS)(v), F.when((kind(v) != "BIGINT") | (get(v, "bigint") < 1), "plan_value"))


def first_of(codes: Column) -> Column:
    """The first code of an array that is not null."""
    return F.get(F.filter(codes, lambda c: c.isNotNull()), 0)


def page_range(v: Column) -> Column:
    """A pair of page indexes in ascending order; a missing or third element is of the wrong type."""
    ends = get(v, "array<variant>")
    judged = F.transform(F.slice(ends, 1, 2), page_index)
    low, high = (get(F.get(ends, k), "bigint") for k in (0, 1))
    return F.coalesce(typed("^ARRAY<")(v), first_of(judged), F.when(F.size(ends) != 2, "plan_type"), F.when(low > high, "plan_value"))


def selection(v: Column) -> Column:
    """Ascending disjoint pairs; the first fault in their order counts."""
    pairs = get(v, "array<variant>")
    ends = get(v, "array<array<bigint>>")
    after = F.exists(
        F.sequence(F.lit(1), F.greatest(F.size(ends) - 1, F.lit(1))),
        lambda k: F.coalesce(F.get(F.get(ends, k), F.lit(0)) <= F.get(F.get(ends, k - 1), F.lit(1)), F.lit(False)),
    )
    return F.coalesce(
        typed("^ARRAY<")(v), F.when(F.size(pairs) == 0, "plan_value"), first_of(F.transform(pairs, page_range)),
        F.when(F.size(pairs) > MAX_RANGE_PAIRS, "plan_limit"), F.when(after, "plan_value"),
    )


def number_kinds(v: Column) -> Column:
    each = get(v, "array<variant>")
    names = get(v, "array<string>")
    return F.coalesce(
        typed("^ARRAY<")(v), first_of(F.transform(each, one_of(NUMBER_KINDS))),
        F.when(F.size(names) != F.size(F.array_distinct(names)), "plan_value"),
    )


def written_fault(v: Column, rule: Rule) -> Column:
    """The rule's code where the value is written. The lambda binds the value, so it is taken out of its object once."""
    return F.get(F.transform(F.array(v), lambda x: F.when(x.isNotNull(), rule(x))), 0)


def fault_of_members(v: Column, members: dict[str, Rule]) -> Column:
    """Faults of the written members, in the order of the table."""
    return F.coalesce(*[written_fault(member(v, name), rule) for name, rule in members.items()])


def unknown(v: Column, members) -> Column:
    return F.when(F.size(F.array_except(keys(v), F.array(*[F.lit(m) for m in members]))) > 0, "plan_unknown_member")


def shape(members: dict[str, Rule], required: str | None = None) -> Rule:
    """An object of these members. ``required`` must be written, else the object is of the wrong type."""
    missing = [] if required is None else [lambda v: F.when(member(v, required).isNull(), "plan_type")]
    return typed("^OBJECT<", lambda v: unknown(v, members), lambda v: fault_of_members(v, members), *missing)


def font(v: Column) -> Column:
    return F.when(kind(v) == "STRING", one_of(["default"])(v)).otherwise(shape({"file": path}, "file")(v))


def style(value: Rule) -> Rule:
    """Size, background and text of a page; ``value`` is the rule of the text itself."""
    text = {
        "value": value, "font": font, "size": length(1.0), "color": color, "x": length(-MAX_SIDE_POINTS), "y": length(-MAX_SIDE_POINTS),
        "width": length(1.0), "leading": number(*LEADING), "anchor": one_of(ANCHORS), "align": one_of(ALIGNMENTS),
        "overflow": one_of(OVERFLOWS), "wrap": one_of(WRAPS),
    }
    return shape({"size": size(True), "background": fill, "text": shape(text)})


page_style = style(string(too_long))
#: A divider says its section's title, so it has no text of its own.
divider_style = style(lambda v: F.lit("plan_value"))

#: ``items`` of the root and of groups; their elements are judged one by one, level by level.
children = typed("^ARRAY<", lambda v: F.when(F.size(get(v, "array<variant>")) == 0, "plan_value"))

ROOT: dict[str, Rule] = {
    "$schema": string(), "version": version, "metadata": shape({"title": described, "author": described, "subject": described, "language": language}),
    "timestamp": whole(0, MAX_TIMESTAMP), "structure": one_of(STRUCTURES), "output": path, "dir": path,
    "fitting": shape({"target": size(False), "tolerance": tolerance}, "target"), "page_defaults": page_style,
    "page_numbers": shape({
        "mode": one_of(NUMBER_MODES), "start": whole(1), "position": one_of(NUMBER_POSITIONS), "kinds": number_kinds,
        "size": length(1.0), "margin": length(0.0),
    }),
    "items": children,
}

ITEM: dict[str, Rule] = {
    "numbering": flag, "source": path, "pages": selection, "page": page_style, "dir": path, "items": children, "count": count,
    "title": title, "start_on": one_of(START_ON), "divider": divider_style, "contents": shape({"title": title, "size": size(False)}),
}


def root_fault(v: Column, written: Column) -> Column:
    """The first fault of a manifest in the order of its members, ``written``; then members that are missing."""
    found = [F.struct(F.array_position(written, name).alias("at"), written_fault(member(v, name), rule).alias("code")) for name, rule in ROOT.items()]
    strange = F.get(F.array_except(written, F.array(*[F.lit(m) for m in ROOT])), 0)
    found.append(F.struct(F.array_position(written, strange).alias("at"), F.when(strange.isNotNull(), "plan_unknown_member").alias("code")))
    first = F.array_min(F.filter(F.array(*found), lambda f: f["code"].isNotNull()))["code"]
    return F.coalesce(
        typed("^OBJECT<")(v), first, F.when(member(v, "version").isNull(), "plan_version_unsupported"),
        F.when(member(v, "items").isNull(), "plan_type"),
    )


def item_fault(v: Column) -> Column:
    """Faults of one item: its members, then whether they make a source, page, contents or useful group."""
    has = lambda name: member(v, name).isNotNull()
    members = F.size(keys(v)) - F.when(has("numbering"), 1).otherwise(0)
    single = lambda name, extra: has(name) & ((members == 1) | (has(extra) & (members == 2)))
    useful = has("numbering") | has("dir") | has("title") | has("start_on")
    foreign = has("source") | has("pages") | has("page") | has("count") | has("contents")
    group = has("items") & useful & (~has("divider") | has("title")) & ~foreign
    shaped = single("source", "pages") | single("page", "count") | (has("contents") & (members == 1)) | group
    return F.coalesce(shape(ITEM)(v), F.when(~shaped, "plan_item_shape"))
