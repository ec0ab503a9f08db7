"""Quality rules: base statistics of a text and a decision list that is learned from labelled documents.

Sequential covering, in Spark: every rule is a conjunction of thresholds on ratios a person can read.  A rule *grows* by
the condition with the greatest information gain on two thirds of the labelled documents, and is *pruned* to the shortest
beginning that does best on the other third; the documents it covers leave, and the next rule is learned from the rest,
until a rule is not precise or not supported enough.  The rules become one ordered conditional expression
(``DecisionList.reason``), so that judging is a projection.

Everything is built-in functions.  Learning covers all labelled documents: cut points come from mergeable quantile
sketches, then equal bins are counted once, and each step of growing is one aggregation to (ratios x cut points) sums,
which is all the driver sees, however many documents or labels there are.

Defined cases: null and empty texts have no words and all-zero statistics; words and blank lines are those of ASCII white
space; a document counts as bad if any of its labels is 0, null labels and ids are not learned from; equal rows count
each; without labels of both kinds the list is empty and keeps everything.  Extra columns stay, except those of the names
added here, which are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import stored

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_capitals", "n_digits", "n_marks"]
#: Ratios that rules look at: numerator and denominator.
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "duplicate_lines": ("n_dup_lines", "n_lines"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "distinct_words": ("n_distinct", "n_words"),
    "word_length": ("word_chars", "n_words"),
    "capitals": ("n_capitals", "word_chars"),
    "digits": ("n_digits", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
}
#: Cut points per ratio and class of documents, rules, conditions of a rule; what a rule needs on the pruning third.
CUTS, MOST_RULES, MOST_CONDITIONS, LEAST_PRECISION, LEAST_SUPPORT = 16, 12, 4, 0.9, 5


def _count(text: Column, characters: str) -> Column:
    """Number of characters of a regular expression's class."""
    return F.length(F.regexp_replace(text, f"[^{characters}]+", "")).cast("long")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with the columns of ``STATISTICS`` (all long)."""
    kept = [c for c in docs.columns if c != text and c not in STATISTICS]
    t = F.col("t")
    rows = docs.select(F.struct(*kept).alias("d") if kept else F.lit(None).alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    said = F.btrim(t, F.lit(SPACES))
    rows = rows.withColumns({
        "w": F.when(said == "", F.array().cast("array<string>")).otherwise(F.split(said, r"[\x20\x09-\x0D]+")),
        "l": F.filter(F.split(t, "\n"), lambda line: F.translate(line, SPACES, "") != ""),
    })
    # windows of three words: where their hashes differ, nothing repeats; else they are sorted by 128 bits with their places,
    # and equal neighbours are repeats
    rows = rows.withColumn("h", F.expr("if(size(w) < 3, cast(array() AS array<bigint>), transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])))"))
    places = "sort_array(transform(h, (v, i) -> struct(struct(v, xxhash64('', w[i], w[i + 1], w[i + 2])) AS v, i AS i)))"
    rows = rows.withColumn("s", F.expr(f"if(size(array_distinct(h)) < size(h), {places}, cast(array() AS array<struct<v:struct<v:bigint,col2:bigint>,i:int>>))"))
    rows = rows.withColumn("r", F.expr("sort_array(filter(transform(s, (x, j) -> if(x.v = get(s, j - 1).v OR x.v = get(s, j + 1).v, x.i, -1)), i -> i >= 0))"))
    covered = F.expr("aggregate(r, struct(-3 AS last, 0L AS n), (a, i) -> struct(i AS last, a.n + least(3, i - a.last) AS n)).n")
    rows = rows.select(
        "d", F.size("w").cast("long").alias("n_words"), F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"), _count(t, SYMBOLS).alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"), covered.cast("long").alias("n_repeat_words"), F.size("l").cast("long").alias("n_lines"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), _count(t, r"\p{Lu}").alias("n_capitals"), _count(t, "0-9").alias("n_digits"), _count(t, "!?").alias("n_marks"))
    return rows.select(*[F.col("d").getField(c).alias(c) for c in kept], *STATISTICS)


def ratio(name: str) -> Column:
    up, down = RATIOS[name]
    return F.when(F.col(down) > 0, F.col(up) / F.col(down)).otherwise(0.0)


@dataclass(frozen=True)
class Condition:
    """``name`` is above (or at most) a threshold."""

    name: str
    above: bool
    threshold: float

    def holds(self) -> Column:
        return ratio(self.name) > self.threshold if self.above else ratio(self.name) <= self.threshold

    def __str__(self):
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """A conjunction, and the bad and good documents of the pruning third that it covered when it was learned."""

    conditions: tuple[Condition, ...]
    bad: int
    good: int

    def holds(self) -> Column:
        return reduce(and_, [c.holds() for c in self.conditions])


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; the first that holds drops the document."""

    rules: tuple[Rule, ...]

    def reason(self) -> Column:
        """Number of the rule that drops a row of ``statistics``, from 1; null if it stays."""
        if not self.rules:
            return F.lit(None).cast("int")
        chosen = F.when(self.rules[0].holds(), 1)
        for k, rule in enumerate(self.rules[1:], 2):
            chosen = chosen.when(rule.holds(), k)
        return chosen

    def __str__(self):
        return "\n".join(f"{k}. {' and '.join(map(str, r.conditions))}: {r.bad} bad, {r.good} good" for k, r in enumerate(self.rules, 1))


def gain(bad: int, good: int, bad_before: int, good_before: int) -> float:
    """Information gain of a condition, by the bad and good documents before and after it."""
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad_before / (bad_before + good_before))) if bad else 0.0


def cut_points(labelled: DataFrame) -> dict[str, list[float]]:
    """Thresholds of every ratio: quantiles of the bad and of the good documents, and the middles between them."""
    parts = [k / (CUTS - 1) for k in range(CUTS)]
    sketches = [F.percentile_approx(F.when(F.col("bad") == kind, ratio(name)), parts, 1000).alias(f"{name}_{kind}") for name in RATIOS for kind in (0, 1)]
    found = labelled.agg(*sketches).first().asDict()
    cuts = {name: sorted({float(x) for kind in (0, 1) for x in found[f"{name}_{kind}"] or []}) for name in RATIOS}
    return {name: sorted({*at, *((a + b) / 2 for a, b in zip(at, at[1:]))}) for name, at in cuts.items()}


def _sums(cells: DataFrame) -> dict[tuple[str, int], tuple[int, int]]:
    """Bad and good documents by ratio and bin."""
    pairs = F.array(*[F.struct(F.lit(name).alias("name"), F.col(name).alias("bin")) for name in RATIOS])
    rows = cells.select(F.explode(pairs).alias("x"), "bad", "good").groupBy("x.name", "x.bin").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    return {(r["name"], r["bin"]): (r["bad"], r["good"]) for r in rows.collect()}


def _within(condition: tuple[str, bool, int]) -> Column:
    """A condition on bins: bin k holds the values over cut k - 1 and up to cut k."""
    name, above, k = condition
    return F.col(name) > k if above else F.col(name) <= k


def best_condition(sums: dict, cuts: dict[str, list[float]]) -> tuple[float, tuple[str, bool, int]] | None:
    """The condition of greatest gain; then that of fewest good documents, the first by name and direction, and the
    narrowest, so that a threshold keeps its distance from documents that stay."""
    found = []
    for name in RATIOS:
        bins = [sums.get((name, k), (0, 0)) for k in range(len(cuts[name]) + 1)]
        bad_before, good_before = sum(b for b, _ in bins), sum(g for _, g in bins)
        bad = good = 0
        for k in range(len(cuts[name])):
            bad, good = bad + bins[k][0], good + bins[k][1]
            for above, b, g in ((True, bad_before - bad, good_before - good), (False, bad, good)):
                worth = gain(b, g, bad_before, good_before)
                if worth > 1e-9 and g < good_before:
                    found.append((-worth, g, name, above, -k if above else k))
    if not found:
        return None
    worth, _, name, above, k = min(found)
    return -worth, (name, above, abs(k))


def learn(stats: DataFrame, labels: DataFrame, id: str = "doc_id", label: str = "quality") -> DecisionList:
    """A decision list against documents of label 0, from ``statistics`` with an id and labels (id, 0 or 1)."""
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(id).alias("_id")).agg((1 - F.min(F.col(label))).cast("int").alias("bad"))
    alike = stats.groupBy(F.col(id).alias("_id"), *STATISTICS).agg(F.count(F.lit(1)).alias("n"))  # many rows of one id meet its label once
    part = F.when(F.crc32(F.col("_id").cast("string").cast("binary")) % 3 == 0, "prune").otherwise("grow")
    labelled = stored(alike.join(known, "_id").withColumn("part", part).drop("_id"), "labelled")
    cuts = cut_points(labelled)
    bins = {name: F.size(F.filter(F.array(*[F.lit(c) for c in cuts[name]]).cast("array<double>"), lambda c: c < value)) for name, value in ((name, ratio(name)) for name in RATIOS)}
    good, bad = F.sum(F.when(F.col("bad") == 0, F.col("n")).otherwise(0)), F.sum(F.when(F.col("bad") == 1, F.col("n")).otherwise(0))
    cells = stored(labelled.select("part", "n", "bad", *[c.alias(name) for name, c in bins.items()]).groupBy("part", *RATIOS).agg(bad.alias("bad"), good.alias("good")), "cells")
    rules: list[Rule] = []
    rest = cells
    while len(rules) < MOST_RULES:
        grown: list[tuple[str, bool, int]] = []
        inside = rest.where("part = 'grow'")
        while len(grown) < MOST_CONDITIONS:
            best = best_condition(_sums(inside), cuts)
            if best is None:
                break
            grown.append(best[1])
            inside = inside.where(_within(best[1]))
        if not grown:
            break
        prefixes = [reduce(and_, [_within(c) for c in grown[: k + 1]]) for k in range(len(grown))]
        counts = rest.where("part = 'prune'").agg(*[F.coalesce(F.sum(F.when(p, F.col(kind))), F.lit(0)).alias(f"{kind}_{k}") for k, p in enumerate(prefixes) for kind in ("bad", "good")]).first()
        worth = [(-((counts[f"bad_{k}"] - counts[f"good_{k}"]) / max(counts[f"bad_{k}"] + counts[f"good_{k}"], 1)), k) for k in range(len(grown))]
        k = min(worth)[1]
        n_bad, n_good = counts[f"bad_{k}"], counts[f"good_{k}"]
        if n_bad < LEAST_SUPPORT or n_bad < LEAST_PRECISION * (n_bad + n_good):
            break
        rules.append(Rule(tuple(Condition(name, above, cuts[name][cut]) for name, above, cut in grown[: k + 1]), n_bad, n_good))
        rest = rest.where(~prefixes[k])
    return DecisionList(tuple(rules))


def base_failed() -> Column:
    """Too short, or over half of it repeated."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """``stats`` with ``base_failed``, ``rule`` (number of the learned rule that holds, else null) and ``kept``."""
    named = stats.withColumn("base_failed", base_failed()).withColumn("rule", rules.reason())
    return named.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
