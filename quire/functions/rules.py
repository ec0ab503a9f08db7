"""Value rules as column expressions: text, titles, language tags, ranges, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.limits import (
    GRANDFATHERED_TAGS, MAX_FIELD_CHARACTERS, MAX_SIDE_POINTS, PAPERS, UNITS,
)

LANGUAGE_TAG = (
    r"^([a-z]{2,3}(-[a-z]{3}){0,3}|[a-z]{4,8})"  # language, extended languages
    r"(-[a-z]{4})?"  # script
    r"(-([a-z]{2}|[0-9]{3}))?"  # region
    r"(-([a-z0-9]{5,8}|[0-9][a-z0-9]{3}))*"  # variants
    r"(-[0-9a-wyz](-[a-z0-9]{2,8})+)*"  # extensions
    r"(-x(-[a-z0-9]{1,8})+)?$"  # private use
)
PRIVATE_TAG = r"^x(-[a-z0-9]{1,8})+$"
VARIANT = r"^([a-z0-9]{5,8}|[0-9][a-z0-9]{3})$"
FORBIDDEN_XML = r"[^\t\n\r\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]"
NOT_SINGLE_LINE = r"[\p{Cc}\p{Cf}\x{2028}\x{2029}]"
VISIBLE = r"[^\p{IsWhite_Space}]"


def language_ok(value: Column) -> Column:
    """A well-formed language tag without repeated variants or extension singletons."""
    tag = F.lower(value)
    repeated = lambda parts: F.size(parts) != F.size(F.array_distinct(parts))
    head = F.split(F.regexp_replace(tag, r"-[a-z0-9]-.*$", ""), "-")
    variants = F.filter(F.slice(head, F.lit(2), F.size(head)), lambda p: p.rlike(VARIANT))
    singles = F.filter(F.split(F.regexp_replace(tag, r"-x-.*$", ""), "-"), lambda p: F.length(p) == 1)
    formed = tag.rlike(LANGUAGE_TAG) & ~repeated(variants) & ~repeated(singles)
    ascii_only = value.rlike(r"^[\x00-\x7F]*$")
    return ascii_only & (tag.isin(GRANDFATHERED_TAGS) | tag.rlike(PRIVATE_TAG) | formed)


def field_ok(value: Column) -> Column:
    """Authored text that XML 1.0 can carry, within the length limit."""
    return ~value.rlike(FORBIDDEN_XML) & (F.length(value) <= MAX_FIELD_CHARACTERS)


def title_ok(value: Column) -> Column:
    """Visible single-line text."""
    return ~value.rlike(NOT_SINGLE_LINE) & value.rlike(VISIBLE) & (F.length(value) <= MAX_FIELD_CHARACTERS)


def ranges_ok(ranges: Column) -> Column:
    """Nonempty, positive, ascending and disjoint ranges."""
    each = F.forall(ranges, lambda r: (r["first"] >= 1) & (r["last"] >= r["first"]))
    tail = F.slice(ranges, 2, F.greatest(F.size(ranges) - 1, F.lit(0)))
    head = F.slice(ranges, 1, F.greatest(F.size(ranges) - 1, F.lit(0)))
    ordered = F.forall(F.zip_with(head, tail, lambda a, b: a["last"] < b["first"]), lambda ok: ok)
    return (F.size(ranges) > 0) & each & ordered


def side_ok(value: Column) -> Column:
    return (value >= 1) & (value <= MAX_SIDE_POINTS)


NUMBER = r"(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)"
DIMENSIONS = rf"^({NUMBER})x({NUMBER})(pt|mm|cm|in)?$"
LENGTH = rf"^(-?{NUMBER})(pt|mm|cm|in)?$"


def unit_factor(unit: Column) -> Column:
    """Points per unit; no unit means points."""
    factors = {"": 1.0, **{name: top / bottom for name, (top, bottom) in UNITS.items()}}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in factors.items() for x in pair]), unit)


def paper_size(name: Column) -> Column:
    """A struct of width and height in points, null for an unknown name."""
    entries = []
    for paper, (width, height, unit) in PAPERS.items():
        top, bottom = UNITS[unit]
        entries += [F.lit(paper), F.struct(F.lit(width * top / bottom).alias("width"), F.lit(height * top / bottom).alias("height"))]
    return F.try_element_at(F.create_map(*entries), name)


def parse_size(text: Column) -> Column:
    """A struct of width, height (points, null to inherit) and reject (null when accepted)."""
    group = lambda number: F.regexp_extract(text, DIMENSIONS, number)
    side = lambda number: group(number).try_cast("double") * unit_factor(group(3))
    explicit = F.struct(side(1).alias("width"), side(2).alias("height"))
    found = F.when(text.rlike(DIMENSIONS), explicit).otherwise(paper_size(text))

    def judge(size):
        inside = side_ok(size["width"]) & side_ok(size["height"])
        unknown = F.when(text != "inherit", "size_grammar")
        return F.struct(
            F.when(inside, size["width"]).alias("width"), F.when(inside, size["height"]).alias("height"),
            F.when(size.isNull(), unknown).when(~inside, "size_range").alias("reject"),
        )

    # the lambda binds the parsed size, so the text is taken apart once
    return F.element_at(F.transform(F.array(found), judge), 1)


def parse_tolerance(text: Column) -> Column:
    """A fitting tolerance in points; the exact conversion is rounded to a double once."""
    unit = F.regexp_extract(text, LENGTH, 2)
    value = F.regexp_extract(text, LENGTH, 1).try_cast("decimal(24,12)")
    points = value.cast("double")
    for name, (top, bottom) in UNITS.items():
        if name != "pt":
            exact = (value * F.lit(top).cast("decimal(5,0)")) / F.lit(bottom).cast("decimal(4,0)")
            points = F.when(unit == name, exact.cast("double")).otherwise(points)
    return F.when(text.rlike(LENGTH) & (points >= 0) & (points <= MAX_SIDE_POINTS), F.abs(points))
