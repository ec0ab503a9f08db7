"""Conversation repair against an exhaustive search, by whole conversations and by chunks."""

import hashlib
import random
import zlib
from functools import cache

import pytest

from quire.llm import repair
from quire.llm.queries import damaged
from quire.llm.registry import QUERIES

SPACES = " \t\n\x0b\x0c\r"


def search(rows):
    """Cheapest edits of (role, text) rows, ties ASCII-least, from the end: (cost, audit), and the repaired turns."""
    seen, faults = set(), []
    for role, text in rows:
        said = text.strip(SPACES)
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None)
        seen.add((role, text))

    def after(state, initial):  # 0 nothing, 1 s, 2 u, 3 a
        return {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((state, initial))

    @cache
    def rest(i, state, inserts):
        found = [(0, "", ())] if i == len(rows) and state in (0, 3) else []
        if inserts < 3:
            for name in ("user", "assistant"):
                at = after(state, name[0])
                if at is not None:
                    c, e, t = rest(i, at, inserts + 1)
                    found.append((c + 5, "I" + e, ((name, ""), *t)))
        if i < len(rows):
            role, text = rows[i]
            c, e, t = rest(i + 1, state, 0)
            found.append((c + 2, "D" + e, t))
            if faults[i] not in ("blank", "duplicate"):
                extra = 5 if faults[i] else 0
                for kind, cost, name in (("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant")):
                    at = after(state, name[:1])
                    if at is not None:
                        c, e, t = rest(i + 1, at, 0)
                        found.append((c + cost + extra, kind + e, ((name, text), *t)))
        return min(found, default=(10**9, "", ()))

    cost, audit, turns = rest(0, 0, 0)
    counts = {f: faults.count(f) for f in ("blank", "duplicate", "truncated")}
    return cost, audit, turns, counts


def expected(rows):
    """Result of one conversation of (turn, role, text) in order."""
    cost, audit, turns, counts = search(tuple((r, t) for _, r, t in rows))
    known = [t for t, _, _ in rows if t is not None]
    heads = [r[:1] for _, r, _ in rows]
    return {"gaps": max(known) - min(known) + 1 - len(set(known)) if known else 0, **counts,
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:])), "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()}


def made(seed, n_convs, most):
    """Rows (conv_id, turn, role, text) with faults, nulls, repeats and shared turn numbers."""
    rng, rows = random.Random(seed), []
    for conv in [*range(n_convs), None]:
        for k in range(rng.choice([1, 2, 3, 5, most])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "under"])
            if rng.random() < 0.6:
                role = ["user", "assistant"][k % 2]
            text = rng.choice(["yes.", "no?", "so", "", None, " \t", "Well!", f"text {k}.", f"text {rng.randrange(3)}"])
            rows.append((conv, rng.choice([k, k, k, k + 1, None]), role, text))
    return rows


def in_order(rows):
    """Conversations of rows, each ordered as the operator documents it."""
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    for found in groups.values():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    return groups


def outcome(found):
    rows = {r["conv_id"]: r.asDict() for r in found.conversations.collect()}
    for r in repair.digests(found.pieces).collect():
        rows[r["conv_id"]] |= {"audit": r["audit"], "repaired_sha256": r["repaired_sha256"]}
    return {k: {n: v for n, v in r.items() if n != "conv_id"} for k, r in rows.items()}


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("sizes", [{}, {"chunk_rows": 3, "fan": 2}, {"chunk_bytes": 12, "fan": 1000}])
def test_repair_equals_exhaustive_search(spark, sizes):
    rows = made(5, 40, 24)
    found = outcome(repair.repair(spark.createDataFrame(rows, SCHEMA).repartition(3), **sizes))
    want = {conv: expected(group) for conv, group in in_order(rows).items()}
    assert found == want


def test_one_conversation_over_many_partitions(spark):
    rows = [(7, k % 9, ["user", "assistant", "system"][k % 3], f"{k % 50} words{'.' * (k % 4 > 0)}") for k in range(120)] + [(8, 1, "user", "a."), (8, 1, "user", "a.")]
    found = outcome(repair.repair(spark.createDataFrame(rows, SCHEMA), chunk_rows=5, fan=3))
    assert found == {conv: expected(group) for conv, group in in_order(rows).items()}


@pytest.mark.parametrize("seed", range(4))
def test_decoding_and_composition_equal_search(seed):
    rng = random.Random(seed)
    for _ in range(250):
        n = rng.randrange(9)
        roles = [rng.choice(["user", "assistant", "system", "tool"]) for _ in range(n)]
        texts = [rng.choice(["a.", "b.", "c", "", f"{k}!", f"{k}."]) for k in range(n)]
        codes, _ = repair.fault_codes(roles, texts)
        cost, audit, turns, _ = search(tuple(zip(roles, texts)))
        edits, found, end = repair.decode(codes)
        assert (found, "".join(edits) + repair.TAIL[end]) == (cost, audit)
        assert tuple(repair.applied(edits, roles, texts, repair.START, repair.TAIL[end])) == turns
        if n > 1:
            k = rng.randrange(1, n)
            states, total = repair.along([repair.transfer(codes[:k]), repair.transfer(codes[k:])], repair.START, None)
            parts = repair.decode(codes[:k], states[0], states[1])[0] + repair.decode(codes[k:], states[1], states[2])[0]
            assert (total, "".join(parts) + repair.TAIL[states[2]]) == (cost, audit)


def test_back_pointers_stay_few_where_survivors_coalesce():
    run = repair.Survivors()
    most = 0
    for code in "ua" * 5000 + "!" * 50 + "uuua" * 500 + "sua" * 500:
        run.step(code)
        live = set()
        for node in run.nodes:
            while node is not None:
                live.add(id(node))
                node = node.parent
        most = max(most, len(live))
    assert most < 150 and len(run.final) > 13_400


def test_long_texts_extra_columns_and_empty_tables(spark):
    rows = [(1, 0, "user", "x" * 3_000_000 + "."), (1, 1, "assistant", "y" * 3_000_000), (2, 0, "user", "Hi.")]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS _at", "'x' AS part", "2 AS _spread", "true AS whole", "'y' AS digests")
    assert outcome(repair.repair(frame)) == {conv: expected(group) for conv, group in in_order(rows).items()}
    assert outcome(repair.repair(spark.createDataFrame([], SCHEMA))) == {}


def test_contract_query_equals_plain_python(spark, tmp_path):
    rows = [r for r in made(9, 300, 10)] + [(1000 + k, 0, "user", "Yes.") for k in range(60)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    left = []
    for conv, turn, role, text in rows:
        conv_name, turn_name = (" " if v is None else str(v) for v in (conv, turn))
        kind = zlib.crc32(f"{conv_name}:{turn_name}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else text.translate(dict.fromkeys(map(ord, ".!?"))) if kind == 2 else text
        left += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    want = {conv: expected(group) for conv, group in in_order(left).items()}
    for conv in {r[0] for r in rows} - set(want):
        want[conv] = expected([])
    got = {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in QUERIES["op12_conversation_repair"](spark, str(tmp_path)).collect()}
    assert got == want and any(v["audit"] == "" and v["cost"] == 0 for v in want.values())
    assert damaged(spark.createDataFrame([], SCHEMA)).count() == 0
