import hashlib

import numpy as np
import pytest

from quire.llm import suffixes
from quire.llm.queries import op7_suffix_array


def brute(rows, size=50):
    first = {}
    for i, t in rows:
        if i is not None:
            for k in range(len(t) - size + 1):
                first[t[k : k + size]] = min(i, first.get(t[k : k + size], i))
    out = []
    for i, t in rows:
        mask = np.zeros(len(t) + 2, bool)
        for k in range(len(t) - size + 1):
            if i is not None and first[t[k : k + size]] < i:
                mask[k + 1 : k + 1 + size] = True
        edges = np.flatnonzero(mask[1:] != mask[:-1]).reshape(-1, 2)
        out.append((i, t, [tuple(e) for e in edges.tolist()], bytes(b for b, m in zip(t, mask[1:], strict=False) if not m)))
    return sorted(out, key=str)


def found(spark, rows, **kw):
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, kept string, _h string").repartition(4)
    return sorted(((r["doc_id"], bytes(r["text"]), [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in suffixes.repeated_spans(frame, **kw).collect()), key=str)


def texts(seed=1):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdeé "), rng.integers(3, 9)))
    passages = [" ".join(word() for _ in range(14)) for _ in range(6)]
    rows = []
    for i in range(80):
        parts = [" ".join(word() for _ in range(rng.integers(1, 15)))]
        for _ in range(rng.integers(0, 4)):
            parts += [passages[rng.integers(0, 6)], word()]
        rows.append((int(rng.integers(0, 1000)) * 100 + i, " ".join(parts)))
    rows += [(7, "a" * 300), (8, "b" + "a" * 500), (9, "ab" * 200), (3, "ab" * 100), (5, rows[0][1]), (6, rows[0][1]), (6, rows[0][1]), (4, None), (2, ""), (1, "x" * 49), (10, "x" * 49), (None, rows[1][1]), (11, passages[0][:50]), (12, "日本語" * 60), (13, "本語日" * 60)]
    return rows


def test_order_and_common_prefixes():
    rng = np.random.default_rng(3)
    strings = rng.integers(1, 4, (60, 12))
    for k in range(60):
        strings[k, rng.integers(6, 13) :] = 0
    for c, order, common in suffixes.column_order(strings, 6):
        tails = [bytes(s[c:].astype(np.uint8)).split(b"\0")[0] for s in strings]
        got = [tails[k] for k in order]
        assert got == sorted(tails)
        for k in range(1, 60):
            x, y = got[k - 1], got[k]
            assert common[k] == next((n for n in range(min(len(x), len(y))) if x[n] != y[n]), min(len(x), len(y)))


def test_windows_lie_in_one_string_with_equal_places():
    rng = np.random.default_rng(4)
    data = np.frombuffer(b"".join(rng.choice([b"ab", b"c", b"dd "], 400)), np.uint8)
    ends = np.array([0, 60, 60, 200, len(data)])
    (document, first, count, place), grams = suffixes.minimizers(data, ends, 50)
    windows = [(d, f + k, p - f - k, grams[p]) for d, f, n, p in zip(document, first, count, place, strict=True) for k in range(n)]
    assert sorted(w for _, w, _, _ in windows) == [k for a, b in zip(ends[:-1], ends[1:], strict=True) for k in range(a, b - 49)]
    known = {}
    for _, w, offset, key in windows:
        assert known.setdefault(bytes(data[w : w + 50]), (offset, key)) == (offset, key)


@pytest.mark.parametrize("hot", [4096, 3])
def test_against_brute_force_with_odd_rows(spark, hot):
    rows = texts()
    assert found(spark, rows, hot=hot) == brute([(i, (t or "").encode()) for i, t in rows])


def test_whole_characters_stay_valid(spark):
    rows = texts(2)
    exact = {(i, t): k for i, t, _, k in brute([(i, (t or "").encode()) for i, t in rows])}
    for i, t, spans, kept in found(spark, rows, characters=True):
        assert len(kept.decode()) >= 0 and 0 <= len(kept) - len(exact[(i, t)]) <= 6 * (len(spans) + 2)


def test_very_long_and_empty(spark):
    rng = np.random.default_rng(5)
    long = bytes(rng.integers(97, 123, 3_000_000, dtype=np.uint8)).decode()
    rows = [(1, long), (2, "q" + long[1_000_000:1_000_100] + "q"), (3, long)]
    got = found(spark, rows)
    assert [(r[0], r[2]) for r in got] == [(1, []), (2, [(1, 101)]), (3, [(0, 3_000_000)])]
    assert found(spark, []) == []


def test_the_query_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"].encode()) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    expected = {i: (len(t), sum(b - a for a, b in s), len(s), hashlib.sha256(k).hexdigest()) for i, t, s, k in brute(docs)}
    assert {i: tuple(v) for i, *v in op7_suffix_array(spark, "/root/testdata/sf0.001").collect()} == expected
