"""Runs against a brute-force search over all periods and stretches."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from quire.llm import periods
from quire.llm.registry import QUERIES


def brute(words):
    """Maximal stretches by every period; those with a smaller period are left out."""
    n, runs = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(24, 3 * q) and not any(all(words[x] == words[x + d] for x in range(i, i + length - d)) for d in range(1, q)):
                runs.append((i, length, q))
            i = j
    return sorted(runs, key=lambda r: (r[0], r[2]))


def made(rng):
    """Words with stretches of various periods, some inside others, some touching."""
    words = []
    for _ in range(rng.randrange(6)):
        kind, size = rng.randrange(4), rng.choice([1, 2, 3, 5, 8, 9, 15, 16, 17, 31, 40])
        unit = [rng.choice("abcdefgh"[: rng.choice([1, 2, 8])]) for _ in range(size)]
        if kind == 0:
            words += unit
        elif kind == 1:
            words += (unit * 40)[: rng.randrange(20, 5 * size + 40)]
        elif kind == 2:
            words += ((unit * 3 + [rng.choice("ab")]) * 9)[: rng.randrange(20, 250)]
        else:
            words += [f"w{rng.randrange(300)}" for _ in range(rng.randrange(60))]
    return words


def caught(words):
    near = periods.near_copies([np.fromiter(map(hash, words), np.int64, len(words))])[0]
    return [] if near is None else periods.catch(words, near)


@pytest.mark.parametrize("seed", range(6))
def test_catchers_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(120):
        words = made(rng)
        assert caught(words) == brute(words)


def test_borders_of_length_and_period():
    other = [f"x{k}" for k in range(40)]
    assert caught(other[:9] + ["a"] * 23 + other) == [] and caught(other[:9] + ["a"] * 24 + other) == [(9, 24, 1)]
    unit = [f"u{k}" for k in range(9)]
    assert caught(unit * 3) == [(0, 27, 9)] and caught((unit * 3)[:-1]) == []
    assert caught(["a", "b"] * 12) == [(0, 24, 2)]
    for q in (100, 127, 128, 129):
        unit = [f"u{k}" for k in range(q)]
        for offset in (0, 1, 63, 64, 127):
            assert caught([f"y{k}" for k in range(offset)] + unit * 3) == [(offset, 3 * q, q)]


def test_near_copies_of_several_texts_do_not_mix():
    a, b = [f"a{k}" for k in range(8)], [f"b{k}" for k in range(8)]
    hashed = [np.fromiter(map(hash, w), np.int64, len(w)) for w in (a, a, [], a + b + a, ["x"] * 3, b + ["c"] + b)]
    found = periods.near_copies(hashed)
    assert [None if f is None else f.tolist() for f in found] == [None, None, None, [16, periods.FAR, periods.FAR], None, [9, periods.FAR]]


def test_nulls_long_texts_repeats_clashes_and_empty_tables(spark):
    rows = [(1, None, "n"), (2, "", "e"), (2, "a " * 30, "r"), (2, "a " * 30, "r"), (None, "b c " * 30 + "\x1fq", "u"), (5, "lorem ipsum dolor " * 200_000, "long")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _text string").selectExpr("*", "7 AS runs", "'q' AS collapsed")
    found = sorted(((r["doc_id"] or 0, r["_text"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periods.find_runs(frame).collect()))
    assert found == [(0, "u", 31, [(0, 30, 1)], "b c \x1fq"), (1, "n", 0, [], ""), (2, "e", 0, [], ""), (2, "r", 30, [(0, 30, 1)], "a"), (2, "r", 30, [(0, 30, 1)], "a"), (5, "long", 600_000, [(0, 600_000, 3)], "lorem ipsum dolor")]
    assert periods.find_runs(frame.limit(0)).collect() == []


def test_contract_query_equals_plain_python(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, " ".join(made(rng) or ["x"]) if k % 7 else rng.choice([None, "", " \t", "one two  three\n" * 9])) for k in range(400)] + [(None, "a " * 40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want, planted = {}, 0
    for doc, text in rows:
        words = (text or "").encode().split()
        n, h = len(words), zlib.crc32(str(doc).encode()) if doc is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        runs = brute(words)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        want[doc] = (len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
                     hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
                     hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = {r["doc_id"]: tuple(r[c] for c in names) for r in QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()}
    assert got == want and planted > 20
