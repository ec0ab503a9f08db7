"""Renames around authored names that look generated, against handing out numbers one by one."""

import random

import pytest

from quire.operators import names

PREFIX = "packet.destination"
SCHEMA = "packet_id bigint, part bigint, name string, page bigint"


def one_by_one(rows):
    """(packet, part, name) -> (new name, renamed) of rows (packet, part, name, page)."""
    wanted = {}
    for packet in {r[0] for r in rows}:
        used = set()
        for part in sorted({r[1] for r in rows if r[0] == packet}):
            listed = {r[2]: r[3] for r in rows if r[:2] == (packet, part)}
            for name in sorted(listed, key=lambda x: x.encode()):
                if listed[name] is None:
                    continue
                chosen = name
                if name in used:
                    n = len(used) + 1
                    while f"{PREFIX}.{n}" in used or f"{PREFIX}.{n}" in listed:
                        n += 1
                    chosen = f"{PREFIX}.{n}"
                used.add(chosen)
                wanted[(packet, part, name)] = (chosen, chosen != name)
    return wanted


def made(rng, packet, parts, numbers, share):
    rows = []
    for part in range(1, parts + 1):
        listed = {rng.choice("abcdefgh") for _ in range(rng.randrange(5))}
        listed |= {f"{PREFIX}.{rng.randrange(1, numbers)}" for _ in range(rng.randrange(3)) if rng.random() < share}
        if rng.random() < 0.1:
            listed |= {f"{PREFIX}.007", f"{PREFIX}.99999999999999999999", f"{PREFIX}.0", f"{PREFIX}.x"}
        rows += [(packet, part, name, None if rng.random() < 0.2 else 1) for name in listed]
    return rows


def got(spark, rows, limit):
    spark.conf.set("spark.quire.groupLimit", limit)
    try:
        found = names.rename_collisions(spark.createDataFrame(rows, SCHEMA)).collect()
    finally:
        spark.conf.unset("spark.quire.groupLimit")
    assert len(found) == sum(r[3] is not None for r in rows)
    return {(r.packet_id, r.part, r.name): (r.to, r.renamed) for r in found}


@pytest.mark.parametrize("limit", ["100000", "3"])
def test_random_packets(spark, limit):
    rng = random.Random(11)
    rows = [r for packet in range(260) for r in made(rng, packet, rng.randrange(1, 14), rng.choice([8, 20, 50]), rng.choice([0.2, 0.6, 1.0]))]
    assert got(spark, rows, limit) == one_by_one(rows)


def test_thousands_of_authored_names_in_one_packet(spark):
    rng = random.Random(2)
    rows = [(1, part, name, 1) for part in range(1, 1500) for name in ["a", "b", f"{PREFIX}.{part * 3}", f"{PREFIX}.{part + 700}"]]
    rows += [(1, part, f"{PREFIX}.{rng.randrange(1, 5000)}", None) for part in range(2000, 2300)] + [(1, part, "b", 1) for part in range(2000, 2300)]
    rows = list({r[:3]: r for r in rows}.values())
    assert got(spark, rows, "100000") == one_by_one(rows)


def test_number_of_written_tables_does_not_depend_on_the_names(spark, monkeypatch):
    written = []
    durable = names.durable
    monkeypatch.setattr(names, "durable", lambda frame: written.append(1) or durable(frame))
    counts = []
    for size in (3, 200):
        written.clear()
        rows = [(1, part, name, 1) for part in range(1, size) for name in ["a", f"{PREFIX}.{part + 1}"]]
        assert got(spark, rows, "100000") == one_by_one(rows)
        counts.append(len(written))
    assert counts[0] == counts[1]
