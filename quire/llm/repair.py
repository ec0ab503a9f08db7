"""Repair of damaged conversations: the cheapest edits that make the roles alternate again.

A repaired conversation is empty, or has an optional system turn and then pairs of a user and an assistant turn.
Turns are kept (free), given the other role (1), deleted (2), or an empty one is inserted (5); blank and repeated turns
have to go, and a truncated turn that stays costs 5.  Of all cheapest edits the one whose initials (``D``, ``I``,
``K``, ``R``) come first in ASCII order is chosen.

The method is Viterbi decoding over four states (nothing said yet, after a system, a user, an assistant turn) with
*survivor coalescence*: back pointers form a tree whose nodes count their references.  A node that no survivor needs is
freed, and once all survivors share an ancestor, the edits up to it are final and leave the tree, so that memory follows
the unresolved part only.  Survivors of equal cost are told apart by their complete unresolved suffixes.

Rows are sorted by range, so a conversation may spread over many partitions.  Each partition is read in order; a
conversation that lies inside it and in one chunk is settled at once.  Others are cut into chunks: the costs and the
order of the best edits from every entry to every exit state of a chunk are composed along the conversation, in blocks
of ``fan`` chunks, and each chunk is then decoded between its two known states.  No task holds more than a chunk.

Defined cases: a null role or text is one space (so a null text is blank); null turns come first; turns with equal
numbers are ordered by role and by the SHA-256 of the text, so that copies are neighbours; a null conversation id is an
id of its own; an empty table has no conversations; texts may have any length (a longer one is a chunk by itself).
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quire.llm.common import stored
from quire.operators.scan import join_null_safe, with_positions

#: Turns and bytes of text that one chunk holds at most (one turn at least), and chunks composed by one task.
CHUNK_ROWS, CHUNK_BYTES, FAN = 4096, 4 << 20, 4096
BATCH_BYTES = 8 << 20
SPACES = " \t\n\x0b\x0c\r"

START, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 60
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: State after an inserted or rerolled turn: a user turn unless one is open.
NEXT = (USER, USER, ASSISTANT, USER)
#: Inserted turns that end a conversation well, by state.
TAIL = ("", "II", "I", "")
#: Cost at most by which a survivor (row) can imitate every ending of another (column).
IMITATE = ((0, 0, 5, 0), (10, 0, 5, 10), (7, 5, 0, 5), (2, 0, 5, 0))
LEGAL = {"su", "ua", "au"}


class Node:
    """A back pointer: the edits of one turn after those of ``parent``, and how many nodes or survivors need it."""

    __slots__ = ("parent", "edits", "state", "needed")

    def __init__(self, parent, edits, state):
        self.parent, self.edits, self.state, self.needed = parent, edits, state, 0


def earlier(a: Node, b: Node) -> bool:
    """Whether the unresolved edits up to ``a`` come before those up to ``b``; both end at the same turn.

    The suffixes are compared whole: from both ends back to where they part.
    """
    while a.parent is not b.parent:
        a, b = a.parent, b.parent
    return a.edits < b.edits


def moves(code: str) -> tuple:
    """Edits of one turn by state before it: (edits, cost, state after).

    ``code`` is the turn's role initial (``-`` if no legal one), in upper case if the turn is truncated, or ``!`` if it
    has to go.  Insertions before a deletion are left out: after it they cost the same and come first in the order.
    """
    found = []
    for state in range(4):
        options = [("D", DELETE, state)]
        if code != "!":
            initial, extra = code.lower(), TRUNCATED if code.isupper() or code == "_" else 0
            for inserted, cost, at in (("", 0, state), ("I", INSERT, NEXT[state])):
                if (initial == "u" and at != USER) or (initial == "a" and at == USER):
                    options.append((inserted + "K", cost + extra, NEXT[at]))
                elif initial == "s" and at == START:
                    options.append((inserted + "K", cost + extra, SYSTEM))
                options.append((inserted + "R", cost + REROLE + extra, NEXT[at]))
        found.append(tuple(options))
    return tuple(found)


#: The role initials, the same of truncated turns (``_`` for any other role), and a turn to delete.
MOVES = {code: moves(code) for code in "sua-SUA_!"}


class Survivors:
    """The best edits into every state, from one entry state on."""

    def __init__(self, entry: int = START, prune: bool = True):
        self.root = Node(None, "", entry)
        self.root.needed = 1
        self.costs: list[int] = [NEVER] * 4
        self.costs[entry] = 0
        self.nodes: list[Node | None] = [None] * 4
        self.nodes[entry] = self.root
        self.prune, self.final = prune, []

    def step(self, code: str) -> None:
        """One more turn."""
        options, costs, nodes = MOVES[code], [NEVER] * 4, [None] * 4
        for state, node in enumerate(self.nodes):
            if node is None:
                continue
            before = self.costs[state]
            for edits, cost, after in options[state]:
                cost += before
                if cost > costs[after]:
                    continue
                new = Node(node, edits, after)
                if cost < costs[after] or earlier(new, nodes[after]):
                    costs[after], nodes[after] = cost, new
        if self.prune:
            for p in range(4):
                if costs[p] != NEVER and any(costs[q] + IMITATE[q][p] < costs[p] for q in range(4)):
                    nodes[p] = None
            costs = [c if n is not None else NEVER for c, n in zip(costs, nodes)]
        for node in nodes:
            if node is not None:
                node.needed = 1
                node.parent.needed += 1
        for node in self.nodes:
            while node is not None:
                node.needed -= 1
                if node.needed:
                    break
                node = node.parent
        self.costs, self.nodes = costs, nodes
        self.coalesce()

    def coalesce(self) -> None:
        """Emit the edits that all survivors share."""
        while self.root.needed == 1 and self.root not in self.nodes:
            child = next(n for n in self.nodes if n is not None)
            while child.parent is not self.root:
                child = child.parent
            self.final.append(child.edits)
            child.parent = None
            self.root = child

    def ranks(self) -> list[int]:
        """Places of the survivors in the order of their edits; 9 where there is none."""
        places = [9] * 4
        alive = [s for s in range(4) if self.nodes[s] is not None]
        for s in alive:
            places[s] = sum(o != s and earlier(self.nodes[o], self.nodes[s]) for o in alive)
        return places

    def best(self) -> int:
        """The state to end in, with the tail counted; ties by the order of the edits."""
        places = self.ranks()
        return min((s for s in range(4) if self.nodes[s] is not None), key=lambda s: (self.costs[s] + INSERT * len(TAIL[s]), places[s]))

    def edits(self, exit: int) -> list[str]:
        """Edits of every turn up to the exit state."""
        node, rest = self.nodes[exit], []
        while node is not self.root:
            rest.append(node.edits)
            node = node.parent
        return self.final + rest[::-1]


def decode(codes: str, entry: int = START, exit: int | None = None) -> tuple[list[str], int, int]:
    """Cheapest edits of the turns, their cost and the exit state; with no given exit, the best end of a conversation
    (the cost then counts the tail)."""
    run = Survivors(entry, prune=exit is None)
    for code in codes:
        run.step(code)
    end = run.best() if exit is None else exit
    return run.edits(end), run.costs[end] + (INSERT * len(TAIL[end]) if exit is None else 0), end


def transfer(codes: str) -> tuple[list[int], list[int]]:
    """Costs and order of the best edits from every entry to every exit state (16 values each)."""
    costs, ranks = [], []
    for entry in range(4):
        run = Survivors(entry, prune=False)
        for code in codes:
            run.step(code)
        costs += run.costs
        ranks += run.ranks()
    return costs, ranks


def compose(first: tuple, second: tuple) -> tuple[list[int], list[int], list[int]]:
    """Costs, order and middle states of two transfers in a row."""
    costs, ranks, middles = [], [], []
    for p in range(4):
        row = []
        for q in range(4):
            options = [(first[0][4 * p + m] + second[0][4 * m + q], first[1][4 * p + m], m) for m in range(4) if first[0][4 * p + m] < NEVER and second[0][4 * m + q] < NEVER]
            row.append(min(options, default=(NEVER, 9, -1)))
        keys = [(r[1], second[1][4 * r[2] + q]) if r[2] >= 0 else None for q, r in enumerate(row)]
        costs += [r[0] for r in row]
        middles += [r[2] for r in row]
        ranks += [9 if k is None else sum(o is not None and o < k for o in keys) for k in keys]
    return costs, ranks, middles


def along(transfers: list[tuple], entry: int, exit: int | None) -> tuple[list[int], int]:
    """States between transfers in a row, both ends included, and the cost; ``exit`` None ends a conversation."""
    total, middles = transfers[0], []
    for t in transfers[1:]:
        costs, ranks, between = compose(total, t)
        total = (costs, ranks)
        middles.append(between)
    if exit is None:
        cost, _, exit = min((total[0][4 * entry + q] + INSERT * len(TAIL[q]), total[1][4 * entry + q], q) for q in range(4) if total[0][4 * entry + q] < NEVER)
    else:
        cost = total[0][4 * entry + exit]
    states = [exit]
    for between in reversed(middles):
        states.append(between[4 * entry + states[-1]])
    return [entry, *states[::-1]], cost


def fault_codes(roles: list[str], texts: list[str], digests: list[str] | None = None, before: Iterable[str] = ()) -> tuple[str, dict]:
    """Codes of turns for ``moves`` and the counts of their first faults.

    ``digests`` of the turns and ``before``, those of earlier chunks, find repeats; else roles and texts do.
    """
    seen, codes, counts = set(before), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for role, text, key in zip(roles, texts, digests or zip(roles, texts)):
        said = text.rstrip(SPACES)
        fault = "blank" if not said else "duplicate" if key in seen else "truncated" if said[-1] not in ".!?" else None
        seen.add(key)
        if fault:
            counts[fault] += 1
        initial = role[:1] if role[:1] in ("s", "u", "a") else "-"
        codes.append("!" if fault in ("blank", "duplicate") else {"-": "_"}.get(initial, initial.upper()) if fault else initial)
    return "".join(codes), counts


def initials(roles: list[str]) -> str:
    return "".join(r[0] if r[:1] in ("s", "u", "a") else "-" for r in roles)


def illegal(of: str) -> int:
    """Neighbours whose role initials may not follow each other."""
    return sum(of[i : i + 2] not in LEGAL for i in range(len(of) - 1))


def applied(edits: list[str], roles: list[str], texts: list[str], entry: int, tail: str = "") -> list[tuple[str, str]]:
    """The repaired turns."""
    state, turns = entry, []
    names = {USER: "user", ASSISTANT: "assistant"}
    for edit, role, text in zip([*edits, tail], [*roles, ""], [*texts, ""]):
        for kind in edit:
            if kind == "D":
                continue
            state = SYSTEM if kind == "K" and role[:1] == "s" else NEXT[state]
            turns.append((role, text) if kind == "K" else (names[state], text if kind == "R" else ""))
    return turns


def turn_facts(turns: list) -> dict:
    known = [t for t in turns if t is not None]
    return {"low": known[0] if known else None, "high": known[-1] if known else None, "n_turns": len(set(known))}


def gaps(low, high, n_turns) -> int:
    return 0 if low is None else high - low + 1 - n_turns


COUNTS = ["blank", "duplicate", "truncated", "illegal", "cost"]
MESSAGE = "struct<role:string,text:string>"


def cut(batches: Iterator[pa.RecordBatch], schema: pa.Schema, most_rows: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Ordered turns of a partition as settled conversations or, where more may follow elsewhere, as chunks."""
    out, size = [], 0
    conv, first, flushed, opened = None, True, False, False  # of the conversation being read
    rows: list[tuple] = []
    n_bytes = 0

    def chunk():
        ats, turns, roles, texts = zip(*rows)
        found = {"conv_id": conv, "part": ats[0], "whole": False, "messages": [{"role": r, "text": t} for r, t in zip(roles, texts)], **turn_facts(turns)}
        return found

    def settled():
        ats, turns, roles, texts = zip(*rows)
        codes, counts = fault_codes(roles, texts)
        edits, cost, end = decode(codes)
        said = applied(edits, roles, texts, START, TAIL[end])
        facts = turn_facts(turns)
        return {"conv_id": conv, "part": ats[0], "whole": True, "audit": "".join(edits) + TAIL[end], "messages": [{"role": r, "text": t} for r, t in said],
                "gaps": gaps(**facts), "illegal": illegal(initials(roles)), "cost": cost, **counts, **facts}

    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in ("conv_id", "_at", "turn", "role", "text")]
        for c, at, turn, role, text in zip(*columns):
            if opened and c != conv:
                out.append(chunk() if first or flushed else settled())
                size, rows, n_bytes, first, flushed = size + n_bytes, [], 0, False, False
            elif opened and (len(rows) >= most_rows or n_bytes + len(text) > most_bytes):
                out.append(chunk())
                size, rows, n_bytes, flushed = size + n_bytes, [], 0, True
            conv, opened = c, True
            rows.append((at, turn, role, text))
            n_bytes += len(text)
            if size > BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, size = [], 0
    if rows:
        out.append(chunk())
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def measure(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Codes, counts and transfer of every chunk."""
    for batch in batches:
        for row in batch.to_pylist():
            roles, texts = [m["role"] for m in row["messages"]], [m["text"] for m in row["messages"]]
            codes, counts = fault_codes(roles, texts, row["digests"], row["seen"] or ())
            named = initials(roles)
            costs, ranks = transfer(codes)
            found = {k: row[k] for k in ("conv_id", "part", "low", "high", "n_turns")}
            yield pa.RecordBatch.from_pylist([{**found, **counts, "codes": codes, "first": named[0], "last": named[-1], "illegal": illegal(named), "costs": costs, "ranks": ranks}], schema)


def decoded(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Repaired turns of every chunk, between its known states."""
    for batch in batches:
        for row in batch.to_pylist():
            edits, _, _ = decode(row["codes"], row["entry"], row["exit"])
            tail = TAIL[row["exit"]] if row["ends"] else ""
            said = applied(edits, [m["role"] for m in row["messages"]], [m["text"] for m in row["messages"]], row["entry"], tail)
            yield pa.RecordBatch.from_pylist([{"conv_id": row["conv_id"], "part": row["part"], "audit": "".join(edits) + tail, "messages": [{"role": r, "text": t} for r, t in said]}], schema)


def _between(rows: pd.DataFrame, final: bool) -> pd.DataFrame:
    """Entry and exit states of the transfers of one conversation or block, in order."""
    rows = rows.sort_values("part")
    entry, exit = (START, None) if final else (int(rows["entry"].iloc[0]), int(rows["exit"].iloc[0]))
    states, cost = along(list(zip(rows["costs"], rows["ranks"])), entry, exit)
    ends = bool(final or rows["ends"].iloc[0])
    return pd.DataFrame({"part": rows["part"].to_numpy(), "entry": states[:-1], "exit": states[1:], "ends": [False] * (len(rows) - 1) + [ends], "cost": [cost] + [0] * (len(rows) - 1)})


BETWEEN = "part long, entry int, exit int, ends boolean, cost long"


def boundaries(transfers: DataFrame, fan: int) -> DataFrame:
    """States before and after every chunk (``conv_id``, ``part``, ``costs``, ``ranks``), whether it ends its
    conversation, and the cost of the conversation on its first chunk.

    A conversation of more than ``fan`` chunks is first composed in blocks of ``fan``, again and again.
    """
    most = transfers.groupBy("conv_id").count().agg(F.max("count")).first()[0]
    if (most or 0) <= fan:
        return transfers.groupBy("conv_id").applyInPandas(lambda rows: _between(rows, True), BETWEEN)

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        total = (list(rows["costs"].iloc[0]), list(rows["ranks"].iloc[0]))
        for t in zip(rows["costs"].iloc[1:], rows["ranks"].iloc[1:]):
            total = compose(total, t)[:2]
        return pd.DataFrame({"conv_id": rows["conv_id"].iloc[:1], "part": rows["part"].iloc[:1], "_block": rows["_block"].iloc[:1], "costs": [total[0]], "ranks": [total[1]]})

    numbered = with_positions(transfers.select("conv_id", "part", "costs", "ranks"), ["conv_id"], ["part"], out="_pos")
    numbered = stored(numbered.withColumn("_block", F.expr(f"(_pos - 1) div {fan}")).drop("_pos"), "blocks")
    kind = transfers.schema["conv_id"].dataType.simpleString()
    blocks = stored(numbered.groupBy("conv_id", "_block").applyInPandas(block, f"conv_id {kind}, part long, _block long, costs array<long>, ranks array<int>"), "transfers")
    outer = boundaries(blocks.drop("_block"), fan)
    known = blocks.select("conv_id", "_block", "part").join(outer, "part").drop("part")
    inner = join_null_safe(numbered, known, ["conv_id", "_block"])
    found = inner.groupBy("conv_id", "_block").applyInPandas(lambda rows: _between(rows, False), BETWEEN).drop("cost")
    starts = outer.select("part", "cost")  # a block begins with its first chunk
    return found.join(starts, "part", "left").select("part", "entry", "exit", "ends", F.coalesce("cost", F.lit(0)).alias("cost"))


class Repaired(NamedTuple):
    """``conversations``: conv_id, gaps, blank, duplicate, truncated, illegal, cost.  ``pieces``: conv_id, part, whole,
    audit and messages (role, text); the pieces of a conversation in the order of ``part`` are its repaired turns, and a
    ``whole`` one is all of it."""

    conversations: DataFrame
    pieces: DataFrame


def repair(conversations: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES, fan: int = FAN) -> Repaired:
    """Repair all conversations of a table (``conv_id``, ``turn``, ``role``, ``text``)."""
    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.monotonically_increasing_id().alias("_spread")
    ).withColumn("_digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    order = ["conv_id", "turn", "role", "_digest"]
    dealt = rows.repartitionByRange(*order, "_spread").sortWithinPartitions(*order)
    ordered = dealt.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("_at"))
    facts = "low long, high long, n_turns long"
    kind = conversations.schema["conv_id"].dataType.simpleString()
    counted = ", ".join(f"{c} long" for c in ["gaps", *COUNTS])
    schema = StructType.fromDDL(f"conv_id {kind}, part long, whole boolean, audit string, messages array<{MESSAGE}>, {facts}, {counted}")
    arrow = to_arrow_schema(schema)
    read = stored(ordered.mapInArrow(lambda batches: cut(batches, arrow, chunk_rows, chunk_bytes), schema), "turns")
    whole, chunks = read.where("whole"), read.where("NOT whole").select("conv_id", "part", "messages", "low", "high", "n_turns")
    digest = F.transform("messages", lambda m: F.sha2(F.concat(F.length(m["role"]).cast("string"), F.lit(":"), m["role"], m["text"]).cast("binary"), 256))
    chunks = chunks.withColumn("digests", digest)
    # digests that an earlier chunk of the conversation has as well; one row per chunk and digest
    keys = chunks.select("conv_id", "part", F.explode(F.array_distinct("digests")).alias("key"))
    first = keys.groupBy("conv_id", "key").agg(F.min("part").alias("_first"), F.max("part").alias("_last")).where("_first < _last").drop("_last")
    seen = join_null_safe(keys, first, ["conv_id", "key"]).where("_first < part").groupBy("part").agg(F.collect_list("key").alias("seen"))
    schema = StructType.fromDDL(f"conv_id {kind}, part long, {facts}, blank long, duplicate long, truncated long, illegal long, codes string, first string, last string, costs array<long>, ranks array<int>")
    arrow = to_arrow_schema(schema)
    measured = stored(chunks.join(seen, "part", "left").mapInArrow(lambda batches: measure(batches, arrow), schema), "chunks")
    between = stored(boundaries(measured, fan), "states")
    schema = StructType.fromDDL(f"conv_id {kind}, part long, audit string, messages array<{MESSAGE}>")
    arrow = to_arrow_schema(schema)
    known = measured.select("part", "codes").join(between, "part")
    pieces = chunks.select("conv_id", "part", "messages").join(known, "part").mapInArrow(lambda batches: decoded(batches, arrow), schema)
    # neighbours across the borders of chunks
    ordered = Window.partitionBy("conv_id").orderBy("part")
    border = F.concat(F.lag("last").over(ordered), F.col("first"))
    bordered = measured.join(between.select("part", "cost"), "part").withColumns({
        "_illegal": F.when(border.isNotNull() & ~border.isin(*LEGAL), 1).otherwise(0), "_same": F.when(F.lag("high").over(ordered) == F.col("low"), 1).otherwise(0)})
    gap = F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("n_turns") + F.sum("_same"), F.lit(0))
    totals = bordered.groupBy("conv_id").agg(gap.alias("gaps"), *[F.sum(c).alias(c) for c in COUNTS[:3]], F.sum(F.col("illegal") + F.col("_illegal")).alias("illegal"), F.sum("cost").alias("cost"))
    return Repaired(
        whole.select("conv_id", "gaps", *COUNTS).unionByName(totals),
        whole.select("conv_id", "part", "whole", "audit", "messages").unionByName(pieces.withColumn("whole", F.lit(False))),
    )


def _digests(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    conv, state, audit, some = None, None, [], False
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if state is None or row["conv_id"] != conv:
                if state is not None:
                    done.append({"conv_id": conv, "audit": "".join(audit), "repaired_sha256": state.hexdigest()})
                conv, state, audit, some = row["conv_id"], hashlib.sha256(), [], False
            audit.append(row["audit"])
            for m in row["messages"]:
                state.update((("\n" if some else "") + m["role"] + ":" + m["text"]).encode())
                some = True
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
    if state is not None:
        yield pa.RecordBatch.from_pylist([{"conv_id": conv, "audit": "".join(audit), "repaired_sha256": state.hexdigest()}], schema)


def digests(pieces: DataFrame) -> DataFrame:
    """``conv_id``, ``audit`` and the SHA-256 of the repaired turns (``role:text``, joined by newlines).

    Conversations of several pieces are hashed in order, piece by piece, as SHA-256 is sequential.
    """
    line = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"]))
    single = pieces.where("whole").select("conv_id", "audit", F.sha2(F.array_join(line, "\n").cast("binary"), 256).alias("repaired_sha256"))
    schema = StructType.fromDDL(f"conv_id {pieces.schema['conv_id'].dataType.simpleString()}, audit string, repaired_sha256 string")
    arrow = to_arrow_schema(schema)
    ordered = pieces.where("NOT whole").select("conv_id", "part", "audit", "messages").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return single.unionByName(ordered.mapInArrow(lambda batches: _digests(batches, arrow), schema))
