import re

import numpy as np
import xxhash

from quire.llm import simhash
from quire.llm.common import union_find
from quire.llm.queries import op8_simhash


def brute(text, words=4):
    found = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    runs = [b" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or ([b" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(ids, prints, tau=4):
    pairs = [(a, b) for a in range(len(ids)) for b in range(a) if bin(prints[a] ^ prints[b]).count("1") <= tau]
    roots = union_find(len(ids), np.array(pairs or [(0, 0)]))
    return [ids[r] for r in roots]


def test_fingerprints(spark):
    for text in ["", " \t\n", "One", "one two three", "one two three four five", "É é\u00a0x y z z z z z", "a b c d " * 50]:
        assert simhash.fingerprint(text.encode(), 4) == brute(text).to_bytes(8, "big")


def test_no_pair_within_the_distance_is_missed():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 256, (3000, 8), dtype=np.uint8)
    flips = np.zeros((3000, 64), np.uint8)
    for row in flips:
        row[rng.choice(64, rng.integers(0, 5), replace=False)] = 1
    y = x ^ np.packbits(flips, axis=1)
    keys = [simhash.ring_keys(v, 64, 5, 1, True) for v in (x, y)]
    assert (keys[0] == keys[1]).any(axis=1).all()
    assert simhash.within(simhash._words(x), simhash._words(y), 64, 5, 4).all()


def test_the_filter_keeps_what_the_full_check_keeps():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2**63, (20_000, 1), dtype=np.uint64)
    y = x ^ (rng.integers(0, 2**63, x.shape, dtype=np.uint64) & rng.integers(0, 2**63, x.shape, dtype=np.uint64) & rng.integers(0, 2**63, x.shape, dtype=np.uint64) & rng.integers(0, 2**63, x.shape, dtype=np.uint64))
    for m in (4, 5, 8):
        assert np.array_equal(simhash.within(x, y, 64, m, 4), np.bitwise_count(x ^ y).sum(axis=1) <= 4)


def test_the_query_against_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    found = {r["doc_id"]: r for r in op8_simhash(spark, "/root/testdata/sf0.01").collect()}
    ids = sorted(texts)
    prints = [int(found[i]["fingerprint"], 16) for i in ids]
    assert all(prints[k] == brute(texts[i]) for k, i in list(enumerate(ids))[:60])
    assert [found[i]["component_id"] for i in ids] == groups(ids, prints)


def test_large_groups_of_near_copies_and_odd_rows(spark):
    base = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(base[:k % 400] + ["new"] + base[k % 400 :]), k) for k in range(1300)]
    rows += [(5000, None, 1), (5001, "", 1), (5002, " \n", 1), (5003, "x" * 1_000_000, 1), (5003, "x" * 1_000_000, 1), (None, "lonely words here", 1)]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id long")).collect()
    assert len(found) == len(rows)
    by = {r["doc_id"]: r["component_id"] for r in found}
    ids = [r[0] for r in rows[:1300]]
    prints = [int.from_bytes(simhash.fingerprint(t.encode(), 4), "big") for _, t, _ in rows[:1300]]
    assert [by[i] for i in ids] == groups(ids, prints)
    assert by[5000] == by[5001] == by[5002] == 5000 and by[5003] == 5003
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_similarity_is_checked_exactly(spark):
    rng = np.random.default_rng(6)
    vocabulary = [f"v{k}" for k in range(5000)]
    base = rng.choice(vocabulary, 300).tolist()
    rows = [(0, " ".join(base))]
    for k, changes in enumerate([1, 2, 3, 4, 40, 80], 1):
        other = list(base)
        for at in rng.choice(300, changes, replace=False):
            other[at] = "changed"
        rows.append((k, " ".join(other)))
    rows += [(k, " ".join(rng.choice(vocabulary, 300))) for k in range(10, 20)]

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if len((x := shingles(rows[a][1])) & (y := shingles(rows[b][1]))) >= 0.8 * len(x | y)]
    roots = union_find(len(rows), np.array(pairs))
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=5, bits=512, tau=112, m=21, chain=1, halves=False, rings=5, ring=8, similarity=0.8)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {rows[k][0]: rows[r][0] for k, r in enumerate(roots)}


PIPELINE = dict(words=5, bits=512, tau=112, m=21, chain=1, halves=False, rings=5, ring=8, similarity=0.8)


def shingle_set(text):
    w = text.split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def by_similarity(texts):
    """Smallest place that links of similarity 0.8 reach, by comparing all pairs."""
    sets = [shingle_set(t) for t in texts]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if (both := len(sets[a] & sets[b])) >= 0.8 * (len(sets[a]) + len(sets[b]) - both)]
    return union_find(len(texts), np.array(pairs or [(0, 0)])).tolist(), pairs


def linked(spark, texts):
    found = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), **PIPELINE).collect()
    return [c for _, c in sorted((r["doc_id"], r["component_id"]) for r in found)]


def test_every_pair_just_above_the_similarity_is_found(spark):
    rng = np.random.default_rng(7)
    vocabulary = [f"v{k}" for k in range(20_000)]
    texts = []
    for k in range(400):  # one text and one with a stretch of other words: a similarity of 0.78 to 0.84
        base = rng.choice(vocabulary, int(rng.integers(60, 400))).tolist()
        n = len(base) - 4
        gone = max(1, round(n * (1 - (s := 0.78 + 0.06 * k / 400)) / (1 + s)) - 4)
        at = int(rng.integers(0, len(base) - gone))
        texts += [" ".join(base), " ".join([*base[:at], *(f"n{k}x{i}" for i in range(gone)), *base[at + gone :]])]
    expected, pairs = by_similarity(texts)
    assert 150 < len(pairs) < 400
    assert linked(spark, texts) == expected


def test_a_family_around_the_similarity_keeps_all_links(spark):
    rng = np.random.default_rng(8)
    base, texts = [f"w{k}" for k in range(300)], []
    for k in range(120):  # each pair of variants differs in two stretches of its own
        gone, at = int(rng.integers(10, 40)), int(rng.integers(0, 260))
        texts.append(" ".join([*base[:at], *(f"n{k}x{i}" for i in range(gone)), *base[at + gone :]]))
    expected, _ = by_similarity(texts)
    assert linked(spark, texts) == expected
    # a common passage shared by texts of their own
    passage = " ".join(f"p{k}" for k in range(60))
    texts = [f"{passage} " + " ".join(rng.choice([f"v{k}" for k in range(3000)], 40 + k % 50)) for k in range(1200)]
    assert linked(spark, texts) == list(range(1200))


def test_equal_fingerprints_of_different_texts_are_no_duplicates(spark):
    rng = np.random.default_rng(9)
    texts = [" ".join(["again"] * 600 + rng.choice([f"v{k}" for k in range(5000)], 200).tolist()) for _ in range(6)]
    texts.append(texts[0] + " again" * 50)  # another text of a similar set
    assert len({simhash.fingerprint(t.encode(), 5, 512) for t in texts}) == 1
    expected, _ = by_similarity(texts)
    assert linked(spark, texts) == expected and len(set(expected)) == 6
