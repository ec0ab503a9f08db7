"""Packing of tokenised documents into sequences by cutting-stock column generation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quire.llm.common import slices, stored, tidied
from quire.llm.tokens import Chunks, read_ranks

#: Tokens by which lengths are told apart in the linear program.
GRAIN = 16
#: Columns that the linear program may add; it stops earlier when none improves it.
MOST_COLUMNS = 4000

PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary, _part int, _class int, _local long"


def tokenise(documents: DataFrame, ranks_path: str, special: dict[str, int], end_id: int, capacity: int = 2048, text: str = "text", grain: int = GRAIN) -> DataFrame:
    """Pieces of all documents: every whole run of ``capacity`` ids is one, what is left of a document another.

    ``ids`` holds little-endian unsigned 32-bit ids; ``end_id`` closes every document. ``ranks_path`` is the
    rank file of the vocabulary, ``special`` the texts of its added tokens. A null text counts as empty. Rows
    with equal ``doc_id`` are packed like any others. The table is written once: later steps read it.
    """
    marks = {k.encode(): v for k, v in special.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        import tiktoken

        encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(ranks_path), special_tokens={})
        chunks = Chunks(lambda b: encoding.encode_ordinary(b.decode("utf-8", "replace")))
        closing = np.array([end_id], "<u4").tobytes()

        def encoded(data: bytes) -> bytes:
            for mark, id in marks.items():
                if mark in data:
                    middle = np.array([id], "<u4").tobytes()
                    return middle.join(encoded(x) for x in data.split(mark))
            return chunks.of(data)

        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            for some in slices(batch, "_text"):
                rows: list[tuple] = []
                for id, data in zip(some.column("doc_id").to_pylist(), some.column("_text").to_pylist(), strict=True):
                    ids = encoded(data or b"") + closing
                    total = len(ids) // 4
                    for start in range(0, total, capacity):
                        piece = ids[4 * start : 4 * (start + capacity)]
                        n = len(piece) // 4
                        kind = -(-n // grain)
                        rows.append((id, start, n, total, piece, part, kind, seen.get(kind, 0)))
                        seen[kind] = seen.get(kind, 0) + 1
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64())
                names = ["doc_id", "start", "length", "doc_tokens", "ids", "_part", "_class", "_local"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    wanted = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("binary").alias("_text"))
    return stored(wanted.mapInArrow(tidied(run), PIECES), "tokens")


def knapsack(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Most valuable multiset of sizes within the capacity, by dynamic programming over the capacity."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    sizes, values = sizes[order], prices[order]
    for c in range(1, capacity + 1):
        k = np.searchsorted(sizes, c, "right")
        best[c] = best[c - 1]
        if k:
            gained = best[c - sizes[:k]] + values[:k]
            j = int(np.argmax(gained))
            if gained[j] > best[c] + 1e-12:
                best[c], took[c] = gained[j], j
    pattern, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[order[took[c]]] += 1
            c -= sizes[took[c]]
    return float(best[capacity]), pattern


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, capacity: int, columns: int = MOST_COLUMNS) -> list[tuple[np.ndarray, int]]:
    """Patterns (how many pieces of each size) and how often each is cut, so that the demand is met.

    Column generation: the revised simplex method solves the linear program over the patterns so far; the
    knapsack problem with its dual prices yields the pattern that improves it most. Counts are rounded down, and
    the few pieces that this leaves are put into sequences by first fit in decreasing order.
    """
    m = len(sizes)
    if not m:
        return []
    per = capacity // sizes
    patterns = [np.where(np.arange(m) == i, per[i], 0).astype(float) for i in range(m)]
    inverse = np.diag(1.0 / per)
    amount = demand / per
    for _ in range(columns):
        prices = inverse.sum(axis=0)
        value, pattern = knapsack(prices, sizes, capacity)
        if value <= 1 + 1e-6:
            break
        direction = inverse @ pattern
        up = direction > 1e-9
        if not up.any():
            break
        ratios = np.where(up, amount / np.where(up, direction, 1), np.inf)
        leaving = int(np.argmin(ratios))
        step = ratios[leaving]
        amount = np.maximum(amount - step * direction, 0)
        amount[leaving] = step
        row = inverse[leaving] / direction[leaving]
        inverse -= np.outer(direction, row)
        inverse[leaving] = row
        patterns[leaving] = pattern
    plan, rest = [], demand.astype(np.int64).copy()
    for pattern, x in zip(patterns, amount, strict=True):
        times = int(np.floor(x + 1e-9))
        if times > 0:
            plan.append((pattern.astype(np.int64), times))
            rest -= pattern.astype(np.int64) * times
    open_bins: list[list] = []  # room, pattern
    for i in np.argsort(-sizes):
        for _ in range(max(0, int(rest[i]))):
            place = next((b for b in open_bins if b[0] >= sizes[i]), None)
            if place is None:
                place = [capacity, np.zeros(m, np.int64)]
                open_bins.append(place)
            place[0] -= int(sizes[i])
            place[1][i] += 1
    return [*plan, *((b[1], 1) for b in open_bins)]


def assign(pieces: DataFrame, capacity: int = 2048, grain: int = GRAIN) -> DataFrame:
    """The pieces of ``tokenise`` with ``sequence_id`` and ``offset``; further columns stay.

    Pieces are ranked within their length class (counts of the tasks that wrote them give each task's first
    rank), and ranges of ranks go to the patterns. Only the histogram of at most ``capacity / grain`` classes
    reaches the driver, and only the patterns, bounded by it, are broadcast.
    """
    spark = pieces.sparkSession
    tally = pieces.groupBy("_class", "_part").agg((F.max("_local") + 1).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_class").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    bases = stored(tally.withColumn("_base", F.coalesce(before, F.lit(0))), "ranks")
    histogram = {r["_class"]: r["n"] for r in bases.groupBy("_class").agg(F.sum("_n").alias("n")).collect()}
    kinds = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[k] for k in kinds.tolist()], np.int64)
    plan, first, taken = [], 0, np.zeros(len(kinds), np.int64)
    for pattern, times in cutting_stock(kinds, demand, capacity // grain):
        slot = 0
        for i in np.flatnonzero(pattern)[::-1].tolist():
            for _ in range(int(pattern[i])):
                if taken[i] < demand[i]:
                    plan.append((int(kinds[i]), int(taken[i]), int(min(taken[i] + times, demand[i])), first, slot))
                    taken[i] += times
                    slot += 1
        first += times
    places = spark.createDataFrame(plan, "_class int, _from long, _to long, _first long, _slot int")
    ranked = pieces.join(bases.select("_class", "_part", "_base"), ["_class", "_part"]).withColumn("_rank", F.col("_base") + F.col("_local"))
    here = (ranked["_class"] == places["_class"]) & (ranked["_rank"] >= places["_from"]) & (ranked["_rank"] < places["_to"])
    placed = ranked.join(F.broadcast(places), here).drop(places["_class"])
    placed = placed.withColumn("sequence_id", F.col("_first") + F.col("_rank") - F.col("_from"))
    room = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(room), F.lit(0)))
    return placed.drop("_class", "_part", "_local", "_base", "_rank", "_from", "_to", "_first", "_slot")


def sequences(placed: DataFrame, capacity: int = 2048, pad_id: int = 0) -> DataFrame:
    """One row per sequence: ``sequence_id``, ``ids`` padded to the capacity, and ``n_tokens`` without padding."""
    one = F.struct("offset", "ids")
    joined = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(one)).alias("_p"), F.sum("length").alias("n_tokens"))
    ids = F.concat(F.lit(b""), F.aggregate("_p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])))
    pad = np.array([pad_id], "<u4").tobytes() * capacity
    return joined.select("sequence_id", F.substring(F.concat(ids, F.lit(pad)), 1, 4 * capacity).alias("ids"), "n_tokens")
