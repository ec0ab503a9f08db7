"""Next-fit filling through transfer functions, and numbering without a group, against plain loops."""

import random

import pytest

from quire.operators import integrity, layout


def filled(heights, usable, gap):
    page, used, pages = 0, 0, []
    for h in heights:
        if page == 0 or used + h > usable:
            page, used = page + 1, 0
        used += h + gap
        pages.append(page)
    return pages


@pytest.mark.parametrize("seed", range(5))
def test_transfer_functions_follow_any_start(seed):
    rng = random.Random(seed)
    for _ in range(300):
        usable, gap = rng.randrange(1, 60), rng.randrange(0, 8)
        heights = [rng.randrange(0, usable + 1) for _ in range(rng.randrange(1, 40))]
        t = layout._transfer(heights, usable, gap)
        for used in range(0, usable + gap + 1):
            k = max(j for j in range(len(t["most"])) if t["most"][j] >= used)
            pages = layout._fill(heights, usable, gap, 1, used)
            assert pages[-1] == 1 + t["pages"][k]
            last = sum(h + gap for h, p in zip(heights, pages) if p == pages[-1]) + (used if pages[-1] == 1 else 0)
            assert last == (t["used"][k] if t["pages"][k] else used + t["used"][k])


@pytest.mark.parametrize("limit", ["1", "7", "100000"])
def test_packets_of_all_sizes(spark, limit):
    rng = random.Random(4)
    data, wanted = [], []
    for packet, size in enumerate([1, 2, 5, 30, 3000, 1, 400, 0, 77]):
        heights = [rng.choice([0, 1, 3, 20, 50]) if packet % 2 else rng.randrange(51) for _ in range(size)]
        data += [(packet, pos, h) for pos, h in enumerate(heights, 1)]
        wanted += [(packet, pos, page) for pos, page in enumerate(filled(heights, 50, 6), 1)]
    data.append((50, 1, 51))
    spark.conf.set("spark.quire.groupLimit", limit)
    try:
        placed, rejected = layout.paginate_rows(spark.createDataFrame(data, "packet_id bigint, pos bigint, height bigint").repartition(5), 50, 6)
        assert sorted((r.packet_id, r.pos, r.page) for r in placed.collect()) == wanted
        assert [(r.packet_id, r.pos) for r in rejected.collect()] == [(50, 1)]
        assert layout.paginate_rows(spark.createDataFrame([], "packet_id bigint, pos bigint, height bigint"), 50, 6)[0].collect() == []
    finally:
        spark.conf.unset("spark.quire.groupLimit")


def test_tags_skip_reserved_ones(spark):
    rng = random.Random(6)
    text = lambda n: "".join(chr(65 + n // 26**k % 26) for k in reversed(range(6)))
    taken = sorted(rng.sample(range(900), 300))
    identities = sorted({f"id{rng.randrange(10**6)}" for _ in range(500)})
    free = [n for n in range(2000) if n not in set(taken)]
    reserved = spark.createDataFrame([(text(n),) for n in taken] + [("lower",), ("AAAAAA1",), (None,)], "tag string")
    wanted = spark.createDataFrame([(i,) for i in identities + identities[:50]], "identity string").repartition(6)
    got = {r.identity: r.tag for r in integrity.assign_tags(wanted, reserved).collect()}
    assert got == {i: text(n) for i, n in zip(identities, free)}
    assert integrity.assign_tags(wanted.limit(0), reserved).collect() == []
    assert len(integrity.assign_tags(wanted, reserved.limit(0)).collect()) == len(identities)
