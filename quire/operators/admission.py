"""Admission: which items and packets are well formed, and what is wrong with the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import limits as fixed
from quire.functions.rules import field_ok, language_ok, parse_size, ranges_ok, side_ok, title_ok
from quire.operators.scan import RunningSum, scan


def _broken(df: DataFrame, rules: list[tuple[str, str, Column]], keys: list[str]) -> DataFrame:
    """One row per broken rule: all rules are tested in one pass over the row."""
    tests = F.array(*[
        F.when(F.coalesce(condition, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(rule).alias("rule")))
        for rule, code, condition in rules
    ])
    faults = F.filter(tests, lambda x: x.isNotNull())
    return df.select(*keys, F.explode(faults).alias("fault")).select(*keys, "fault.code", "fault.rule")


def item_rules() -> list[tuple[str, str, Column]]:
    """(rule, code, condition that breaks it) over one item row."""
    col = F.col
    source, page, contents, group = (col("kind") == kind for kind in fixed.ITEM_KINDS)
    declared = col("title").isNotNull() | col("dir").isNotNull() | col("start_on").isNotNull() | col("numbering").isNotNull()
    grouped = col("start_on").isNotNull() | col("dir").isNotNull() | F.coalesce(col("divider"), F.lit(False))  # what only groups have
    shape = (
        ~F.coalesce(col("kind").isin(fixed.ITEM_KINDS), F.lit(False))
        | (source & (col("path").isNull() | col("count").isNotNull() | col("text").isNotNull() | col("title").isNotNull() | grouped))
        | (page & (col("path").isNotNull() | col("ranges").isNotNull() | col("title").isNotNull() | grouped))
        | (contents & (col("path").isNotNull() | col("ranges").isNotNull() | col("count").isNotNull() | col("text").isNotNull() | grouped))
        | (group & (col("path").isNotNull() | col("ranges").isNotNull() | col("count").isNotNull() | ~declared))
        | (col("divider") & col("title").isNull())
    )
    titled = col("title").isNotNull() & (group | contents)
    side = lambda name: col(name).isNotNull() & ~side_ok(col(name))
    return [
        ("shape", "plan_item_shape", shape),
        ("path", "path_invalid", source & ((F.length("path") == 0) | F.contains(col("path"), F.lit("\x00")))),
        ("dir", "path_invalid", group & F.contains(col("dir"), F.lit("\x00"))),
        ("text", "plan_value", page & (F.contains(col("text"), F.lit("\x00")) | (F.length("text") > fixed.MAX_FIELD_CHARACTERS))),
        ("count", "plan_value", page & (col("count") < 1)),
        ("count_limit", "plan_limit", page & (col("count") > fixed.MAX_GENERATED_PAGES)),
        ("ranges", "plan_value", source & col("ranges").isNotNull() & ~ranges_ok(col("ranges"))),
        ("title", "plan_value", titled & ~title_ok(col("title"))),
        ("size", "plan_value", side("width") | side("height") | (col("width").isNull() != col("height").isNull())),
        ("divider_text", "plan_value", col("divider") & col("divider_text").isNotNull()),
        ("start_on", "plan_value", col("start_on").isNotNull() & ~col("start_on").isin(fixed.START_VALUES)),
    ]


def packet_rules() -> list[tuple[str, str, Column]]:
    col = F.col
    texts = F.array("title", "author", "subject", "language")
    fitted = col("fit_width").isNotNull() | col("fit_height").isNotNull() | col("fit_tolerance").isNotNull()
    tolerated = F.coalesce(~F.isnan("fit_tolerance") & (col("fit_tolerance") >= 0) & (col("fit_tolerance") <= fixed.MAX_SIDE_POINTS), F.lit(True))
    kinds = col("number_kinds")
    bad_kinds = kinds.isNotNull() & (
        (F.size(F.array_except(kinds, F.array(*[F.lit(k) for k in fixed.NUMBERED_KINDS]))) > 0)
        | (F.size(kinds) != F.size(F.array_distinct(kinds)))
    )
    return [
        ("metadata", "plan_value", F.exists(texts, lambda t: t.isNotNull() & ~field_ok(t))),
        ("language", "plan_value", col("language").isNotNull() & ~language_ok(col("language"))),
        ("timestamp", "plan_value", (col("timestamp") < 0) | (col("timestamp") > fixed.MAX_TIMESTAMP)),
        ("structure", "plan_value", col("structure").isNotNull() & ~col("structure").isin(fixed.STRUCTURE_POLICIES)),
        ("number_mode", "plan_value", col("number_mode").isNotNull() & ~col("number_mode").isin(fixed.NUMBERING_MODES)),
        ("paths", "path_invalid", F.contains(col("output"), F.lit("\x00")) | F.contains(col("dir"), F.lit("\x00"))),
        ("fitting", "plan_value", fitted & ~F.coalesce(side_ok(col("fit_width")) & side_ok(col("fit_height")) & tolerated, F.lit(False))),
        ("number_start", "plan_value", col("number_start") < 1),  # a long has no start past the largest page
        ("number_size", "plan_value", col("number_size").isNotNull() & ~F.coalesce(side_ok(col("number_size")), F.lit(False))),
        ("number_margin", "plan_value", F.isnan("number_margin") | (col("number_margin") < 0) | (col("number_margin") > fixed.MAX_SIDE_POINTS)),
        ("number_kinds", "plan_value", bad_kinds),
        ("number_position", "plan_value", col("number_position").isNotNull() & ~col("number_position").isin(fixed.NUMBER_POSITIONS)),
    ]


#: Columns that rules look at and that tables may lack: they are then absent from every row.
OPTIONAL_ITEM = {"text": "string", "dir": "string", "start_on": "string", "numbering": "boolean", "divider": "boolean", "divider_text": "string"}
OPTIONAL_PACKET = {"output": "string", "dir": "string", "fit_width": "double", "fit_height": "double", "fit_tolerance": "double", "number_size": "double", "number_margin": "double"}


def _with_absent(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in columns.items() if c not in df.columns})


def admit_items(items: DataFrame, packets: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Split items into accepted rows and findings: (ok, findings).

    Item rules look at one row each.  With ``packets``, packet rules are tested as well, and
    the contents rules: at most one contents item, and none without a titled group.
    Accepted items are those without a finding of their own.
    """
    findings = _broken(_with_absent(items, OPTIONAL_ITEM), item_rules(), ["packet_id", "ref"])
    ok = items.join(findings.select("packet_id", "ref").distinct(), ["packet_id", "ref"], "left_anti")
    if packets is not None:
        own = _broken(_with_absent(packets, OPTIONAL_PACKET).withColumn("ref", F.lit(None).cast("string")), packet_rules(), ["packet_id", "ref"])
        shelf = items.groupBy("packet_id").agg(
            F.count(F.when(F.col("kind") == "contents", 1)).alias("_contents"),
            F.count(F.when((F.col("kind") == "group") & F.col("title").isNotNull(), 1)).alias("_sections"),
        ).withColumn("ref", F.lit(None).cast("string"))
        rules = [
            ("contents_once", "plan_value", F.col("_contents") > 1),
            ("contents_sections", "plan_value", (F.col("_contents") > 0) & (F.col("_sections") == 0)),
        ]
        findings = findings.unionByName(own).unionByName(_broken(shelf, rules, ["packet_id", "ref"]))
    return ok, findings


DEFAULT_LIMITS = {
    "items": fixed.MAX_ITEMS, "pairs": fixed.MAX_RANGE_PAIRS, "generated": fixed.MAX_GENERATED_PAGES, "bytes": fixed.MAX_TEXT_BYTES,
}


def limit_breaches(items: DataFrame, limits: dict | None = None, split: bool | None = None) -> DataFrame:
    """Per packet and limit, the first item at which the running total passes it.

    Counts nodes, range pairs, generated pages (counts and dividers) and UTF-8 text bytes.
    """
    limits = {**DEFAULT_LIMITS, **(limits or {})}
    amounts = {
        "items": F.lit(1),
        "pairs": F.coalesce(F.size("ranges"), F.lit(0)),
        "generated": F.when(F.col("kind") == "page", F.coalesce("count", F.lit(1))).otherwise(0) + F.coalesce(F.col("divider").cast("int"), F.lit(0)),
        "bytes": F.coalesce(F.octet_length("title"), F.lit(0)) + F.coalesce(F.octet_length("text"), F.lit(0)),
    }
    summed = scan(items, ["packet_id"], ["pos"], [RunningSum(f"_{name}", amount) for name, amount in amounts.items()], split)
    totals = F.array(*[
        F.struct(F.lit(name).alias("limit"), F.col(f"_{name}").cast("bigint").alias("total"), F.lit(limits[name]).cast("bigint").alias("maximum"))
        for name in amounts
    ])
    passed = summed.select("packet_id", "pos", "ref", F.explode(totals).alias("t")).filter("t.total > t.maximum")
    return passed.groupBy("packet_id", F.col("t.limit").alias("limit")).agg(F.min_by("ref", "pos").alias("ref"), F.min("pos").alias("pos"))


def duplicate_refs(items: DataFrame) -> DataFrame:
    """Identities used more than once, authored or derived for dividers."""
    authored = items.select("packet_id", "ref")
    derived = items.filter(F.coalesce("divider", F.lit(False))).select("packet_id", F.concat("ref", F.lit("/divider")).alias("ref"))
    return authored.unionAll(derived).groupBy("packet_id", "ref").agg(F.count(F.lit(1)).alias("uses")).filter(F.col("uses") > 1)


def normalise_sizes(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Parse a size column into ``width`` and ``height`` points: (accepted, rejected).

    Inherited sizes are accepted with null sides.  The eight paper names are constants of
    the expression, so no join is needed.
    """
    parsed = df.withColumn("_size", parse_size(F.col(column)))
    wide = parsed.withColumns({"width": F.col("_size.width"), "height": F.col("_size.height"), "reject": F.col("_size.reject")}).drop("_size")
    return wide.filter(F.col("reject").isNull()).drop("reject"), wide.filter(F.col("reject").isNotNull())


# Reasons in order of precedence, with the characters they cover (fixed values).  Right to
# left characters of unsupported scripts are reported as script, so only those that Unicode
# files under the common script remain.
PROBLEM_CLASSES = [
    ("tab", r"\t"),
    ("control", r"\p{Cc}&&[^\t\n]"),
    ("separator", r"\x{2028}\x{2029}"),
    ("format", r"\p{Cf}"),
    ("script", r"^\p{IsLatin}\p{IsGreek}\p{IsCyrillic}\p{IsCommon}\p{IsInherited}\p{Cc}\p{Cf}"),
    ("rtl", r"\x{061B}\x{061F}\x{0640}\x{1EC71}-\x{1ECB4}\x{1ED01}-\x{1ED3D}"),
]


# Anything outside the common accepted blocks: a cheap test that sends few texts to the exact one.  Most characters
# are settled by the first class; only what is left is held against the second.
SUSPECT = r"[[^\n\x20-\x7E]&&[^\xA0-\xAC\xAE-\u024F\u0391-\u03A1\u03A3-\u03C9\u0410-\u044F\u2010-\u2027]]"


def text_problem_runs(texts: DataFrame, column: str = "text") -> DataFrame:
    """All runs of unsupported characters with offset, length and reason.

    The text is cut where the class of the characters changes, so a clean text is a single
    piece and nothing is exploded per character or shuffled.  Offsets count code points of
    the text with normalised line ends.
    """
    raw, lf = F.col(column), F.lit("\n")
    unified = F.replace(F.replace(raw, F.lit("\r\n"), lf), F.lit("\r"), lf)
    text = F.when(F.contains(raw, F.lit("\r")), unified).otherwise(raw)
    suspects = texts.withColumn("_text", text).filter(F.col("_text").rlike(SUSPECT))
    edges = "|".join(f"(?<=[{c}])(?=[^{c}])|(?<=[^{c}])(?=[{c}])" if not c.startswith("^") else f"(?<=[{c}])(?=[{c[1:]}])|(?<=[{c[1:]}])(?=[{c}])" for _, c in PROBLEM_CLASSES)
    # cut out the suspicious stretches first, then look closely at those alone; ahead is read more cheaply than behind
    stretches = F.split("_text", f"(?={SUSPECT})(?<!{SUSPECT})|(?!{SUSPECT})(?<={SUSPECT})")
    pieces = F.flatten(F.transform(stretches, lambda p: F.when(p.rlike("^" + SUSPECT), F.split(p, edges)).otherwise(F.array(p))))
    reason = lambda piece: F.coalesce(*[F.when(piece.rlike(f"^[{chars}]"), F.lit(name)) for name, chars in PROBLEM_CLASSES])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<offset:int,run:int,reason:string>>").alias("runs"))

    def step(acc, piece):
        why = reason(piece)
        found = F.array(F.struct(acc["at"].alias("offset"), F.length(piece).alias("run"), why.alias("reason")))
        keep = why.isNotNull()
        return F.struct((acc["at"] + F.length(piece)).alias("at"), F.when(keep, F.concat(acc["runs"], found)).otherwise(acc["runs"]).alias("runs"))

    runs = F.aggregate(pieces, start, step)["runs"]
    kept = [c for c in texts.columns if c != column]
    return suspects.select(*kept, F.explode(runs).alias("r")).select(
        *kept, F.col("r.offset").cast("bigint").alias("offset"), F.col("r.run").cast("bigint").alias("run"), F.col("r.reason").alias("reason")
    )
