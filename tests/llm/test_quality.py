"""Statistics and learned rules against plain Python."""

import math
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from quire.llm import quality
from quire.llm.queries import op11_quality_rules
from quire.llm.registry import QUERIES, reachable, table

SF_DIR = "/root/testdata/sf0.001"


def counted(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len({i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}), "n_lines": len(lines), "n_distinct": len(set(words)),
        "n_capitals": sum(c.isupper() for c in "".join(words)), "n_digits": len(re.findall("[0-9]", text or "")), "n_marks": len(re.findall("[!?]", text or "")),
    }


def test_statistics_equal_plain_python(spark):
    rng = random.Random(4)
    texts = [None, "", " \t\n", "a", "a b", "a b c", "a a a a", "a b a b a b", "x\x1fy\xa0z \x0bq", "#$ %&\n|<>|\n#$ %&\n\n", "été à l'Ère 😀 12", "l\n l\nl\n\n \nl"]
    texts += ["".join(rng.choice("aab  \n\t#!7É") for _ in range(rng.randrange(200))) for _ in range(200)] + ["word " * 300_000 + "end"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS w", "'t' AS t", "2 AS d", "3 AS n_words", "4 AS s")
    found = {r["doc_id"]: r for r in quality.statistics(frame).collect()}
    for k, text in enumerate(texts):
        assert {c: found[k][c] for c in quality.STATISTICS} == counted(text), text
    assert (found[0]["w"], found[0]["t"], found[0]["d"], found[0]["s"]) == (1, "t", 2, 4)
    assert quality.statistics(frame.limit(0)).collect() == [] and quality.statistics(frame.select("text")).columns == quality.STATISTICS


def covering(rows, cuts):
    """Sequential covering over (id, ratios, bad) rows, row by row: [[(name, above, threshold)], bad, good]."""
    ratios = sorted(quality.RATIOS)
    holds = lambda r, c: r[1][c[0]] > c[2] if c[1] else r[1][c[0]] <= c[2]
    grow = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3]
    prune = [r for r in rows if not zlib.crc32(str(r[0]).encode()) % 3]
    found = []
    while len(found) < quality.MOST_RULES:
        inside, rule = grow, []
        while len(rule) < quality.MOST_CONDITIONS:
            b0, g0 = sum(r[2] for r in inside), sum(not r[2] for r in inside)
            best = None
            for name in ratios:
                for above in (False, True):
                    for cut in sorted(cuts[name], reverse=above):
                        held = [r for r in inside if holds(r, (name, above, cut))]
                        b, g = sum(r[2] for r in held), sum(not r[2] for r in held)
                        worth = b * (math.log2(b / (b + g)) - math.log2(b0 / (b0 + g0))) if b else 0.0
                        if worth > 1e-9 and g < g0 and (best is None or (-worth, g) < best[0]):
                            best = ((-worth, g), (name, above, cut))
            if best is None:
                break
            rule.append(best[1])
            inside = [r for r in inside if holds(r, best[1])]
        if not rule:
            break
        sides = []
        for k in range(1, len(rule) + 1):
            held = [r for r in prune if all(holds(r, c) for c in rule[:k])]
            b, g = sum(r[2] for r in held), sum(not r[2] for r in held)
            sides.append((-(b - g) / max(b + g, 1), k, b, g))
        _, k, b, g = min(sides)
        if b < quality.LEAST_SUPPORT or b < quality.LEAST_PRECISION * (b + g):
            break
        found.append((rule[:k], b, g))
        gone = lambda r: all(holds(r, c) for c in rule[:k])  # noqa: B023, E731
        grow, prune = [r for r in grow if not gone(r)], [r for r in prune if not gone(r)]
    return found


def value(stats, name):
    up, down = quality.RATIOS[name]
    return stats[up] / stats[down] if stats[down] > 0 else 0.0


def noisy(n):
    rng, rows = random.Random(8), []
    for k in range(n):
        kind = rng.random()
        words = [rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "consectetur", "elit"]) + str(rng.randrange(50)) for _ in range(rng.randrange(5, 80))]
        if kind < 0.2:
            words = [w + rng.choice(["", "#", "&&"]) for w in words]
        elif kind < 0.35:
            words = [w.upper() if rng.random() < 0.7 else w for w in words]
        elif kind < 0.45:
            words = [w + "!" for w in words]
        rows.append((k, " ".join(words), int(kind > 0.45) if rng.random() < 0.97 else rng.randrange(2)))
    return rows


def test_rules_equal_row_by_row_covering(spark):
    rows = noisy(900)
    stats = quality.statistics(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).cache()
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(1, None), (None, 0), (5_000, 0)], "doc_id long, quality int")
    learned = quality.learn(stats, labels)
    numbers = [(r[0], counted(r[1]), not r[2]) for r in rows]
    plain = [(k, {name: value(s, name) for name in quality.RATIOS}, bad) for k, s, bad in numbers]
    named = stats.join(labels, "doc_id").select(*quality.STATISTICS, (1 - F.col("quality")).alias("bad"))
    want = covering(plain, quality.cut_points(named))
    assert [([(c.name, c.above, c.threshold) for c in r.conditions], r.bad, r.good) for r in learned.rules] == want and len(want) > 1
    judged = {r["doc_id"]: r for r in quality.judge(stats, learned).collect()}
    for k, ratios, _ in plain:
        rule = next((n for n, (conditions, _, _) in enumerate(want, 1) if all(ratios[c] > t if above else ratios[c] <= t for c, above, t in conditions)), None)
        s = counted(rows[k][1])
        failed = s["n_words"] < 50 or 100 * s["n_repeat_words"] > 50 * s["n_words"]
        assert (judged[k]["rule"], judged[k]["base_failed"], judged[k]["kept"]) == (rule, failed, rule is None and not failed)


def test_learning_without_labels_repeats_and_ties(spark):
    stats = quality.statistics(spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string"))
    assert quality.learn(stats, spark.createDataFrame([], "doc_id long, quality int")).rules == ()
    assert quality.learn(stats, spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, quality int")).rules == ()
    assert {r["kept"] for r in quality.judge(stats, quality.DecisionList(())).collect()} == {False}  # two words only
    # rows that share an id count each; an id with labels 0 and 1 is bad
    rows = [(1, "#" + "x y z " * 3)] * 40 + [(k, "#" + "x y z " * 3) for k in range(2, 60)] + [(100 + k, f"good w{k} text") for k in range(80)]
    labels = [(k, 0) for k in range(1, 60)] + [(1, 1)] + [(100 + k, 1) for k in range(80)]
    learned = quality.learn(quality.statistics(spark.createDataFrame(rows, "doc_id long, text string")), spark.createDataFrame(labels, "doc_id long, quality int"))
    assert len(learned.rules) == 1 and learned.rules[0].good == 0


def test_query_covers_all_documents_natively(spark):
    reachable(spark)
    judged = op11_quality_rules(spark, SF_DIR)
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    found = {r["doc_id"]: r for r in QUERIES["op11_quality_rules"](spark, SF_DIR).collect()}
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF_DIR, "documents").collect()}
    assert set(found) == set(texts)
    for k, text in texts.items():
        assert {c: found[k][c] for c in quality.STATISTICS[:5]} == {c: v for c, v in counted(text).items() if c in quality.STATISTICS[:5]}
