"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.scan import shared_folder

#: Bytes of text that a Python task turns into one batch of output.
SLICE_BYTES = 8 << 20
#: Places that wanted ids are hashed to: at most 262,144 words of 64 bits.
SIEVE_BITS = 1 << 24


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``)."""
    return f"{shared_folder(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back, so that no lost executor repeats it."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Remove tables made by ``stored`` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for file in table.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if path.getName().startswith("llm-"):
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def swept(spark: SparkSession) -> None:
    """Let go of what no variable holds any more: shuffle files are deleted once their frames are collected."""
    gc.collect()
    spark._jvm.System.gc()


def released() -> None:
    """Give memory that a Python worker has freed back to the machine; workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def tidied(run: Callable) -> Callable:
    """``run`` (a function of batches), with ``released`` after the last batch."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            released()

    return wrapped


def binary_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column and the n + 1 positions between its rows, without copies."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), bounds


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``limit`` bytes of ``column`` each, or one row."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    start, total = 0, 0
    for k, n in enumerate(lengths.tolist()):
        if k > start and total + n > limit:
            yield batch.slice(start, k - start)
            start, total = k, 0
        total += n
    if start < len(lengths):
        yield batch.slice(start)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that hold every group of ``keys`` whole, from batches in the order of the keys.

    Only the last, unfinished group of a batch is kept back, so memory follows the largest group.
    """
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changes = np.zeros(batch.num_rows, bool)
        for key in keys:
            values = batch.column(key).to_numpy(zero_copy_only=False)
            changes[1:] |= values[1:] != values[:-1]
        last = int(np.flatnonzero(changes)[-1]) if changes.any() else 0
        first_new = any(kept and kept[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys)
        if first_new:
            yield pa.Table.from_batches(kept)
            kept = []
        if last:
            yield pa.Table.from_batches([*kept, batch.slice(0, last)])
            kept = []
        kept.append(batch.slice(last))
    if kept:
        yield pa.Table.from_batches(kept)


def bounds(*columns: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal rows in ordered columns, and the number of rows."""
    n = len(columns[0])
    if not n:
        return np.zeros(1, np.int64)
    changed = np.zeros(n, bool)
    changed[0] = True
    for c in columns:
        changed[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(changed), n)


def in_blocks(rows: DataFrame, keys: list[str], member: str, limit: int = 512, differing: str | None = None) -> DataFrame:
    """Rows of every group with at least two members, dealt so that any two members of a group meet in a task.

    A group of up to ``limit`` rows is one block pair (0, 0). A larger one is cut into blocks by a hash of
    ``member``, and each block is sent to its pair with every block (``_i`` <= ``_j``; the row's own is ``_own``),
    so that no task ever holds more than two blocks of a group, however large the group is. Groups with one value of
    ``differing`` are left out; that column is counted only, and not dealt out with the rows.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *([F.min(differing).alias("_low"), F.max(differing).alias("_high")] if differing else []))
    counts = counts.where("_n > 1" + (" AND _low < _high" if differing else "")).select(*keys, "_n")
    blocks = F.ceil(F.col("_n") / limit).cast("int")
    dealt = rows.drop(*([differing] if differing else [])).join(counts, keys).withColumn("_b", blocks)
    dealt = dealt.withColumn("_own", F.pmod(F.xxhash64(F.col(member), F.lit(7)), F.col("_b")).cast("int"))
    dealt = dealt.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    dealt = dealt.withColumn("_i", F.least("_own", "_k")).withColumn("_j", F.greatest("_own", "_k"))
    return dealt.drop("_n", "_b", "_k")


def sifted(rows: DataFrame, id: str, wanted: DataFrame, bits: int = SIEVE_BITS) -> DataFrame:
    """Rows whose ``id`` may be among ``wanted`` (column ``id``), all that are included, without a shuffle of ``rows``.

    Ids are hashed to ``bits`` places, of which tasks get the taken ones as a table of at most ``bits`` / 64 words, however many
    ids there are. Where places fill up, more rows than wanted stay, never fewer.
    """
    spot = F.pmod(F.xxhash64(F.col("id").cast("long"), F.lit(5)), F.lit(bits))
    taken = wanted.where("id IS NOT NULL").select(spot.alias("_p")).groupBy(F.expr("_p div 64").alias("_w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_p % 64 AS int))")).alias("_taken"))
    placed = rows.withColumn("_p", F.pmod(F.xxhash64(F.col(id).cast("long"), F.lit(5)), F.lit(bits))).withColumn("_w", F.expr("_p div 64"))
    return placed.join(F.broadcast(taken), "_w").where("shiftright(_taken, cast(_p % 64 AS int)) & 1 = 1").select(*rows.columns)


def union_find(n: int, pairs: np.ndarray) -> np.ndarray:
    """Smallest member of the component of each of n nodes; ``pairs`` has two columns."""
    root = np.arange(n)
    a, b = pairs[:, 0], pairs[:, 1]
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, root):
            return root
        root = new


def chained(ids: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect every set of equal roots as a chain, so that no node gets many edges."""
    order = np.lexsort((ids, roots))
    same = roots[order][1:] == roots[order][:-1]
    return ids[order][1:][same], ids[order][:-1][same]


def spanning(n: int, pairs: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Indices of the pairs of a minimum spanning forest of n nodes (Boruvka's rounds); ties go to earlier pairs."""
    order = np.argsort(weight, kind="stable")
    a, b = pairs[order].T
    root, chosen, alive = np.arange(n), [], np.arange(len(order))
    while True:
        alive = alive[root[a[alive]] != root[b[alive]]]
        if not len(alive):
            return order[np.concatenate([*chosen, alive])]
        best = np.full(n, len(order))
        np.minimum.at(best, root[a[alive]], alive)
        np.minimum.at(best, root[b[alive]], alive)
        picked = np.unique(best[best < len(order)])
        chosen.append(picked)
        root = union_find(n, np.stack([root[a[picked]], root[b[picked]]], axis=1))[root]


def components(edges: DataFrame) -> DataFrame:
    """Columns ``id`` and ``component`` (the smallest id that links reach) for all ids of ``edges`` (``a``, ``b``).

    In every round each node goes to its smallest neighbour, pointers are doubled twice, and the links are
    rewritten between what is left, so that at least half of the linked nodes vanish. Minima are combined
    before each shuffle, and no node's links need to lie in one task. Nothing is gathered on the driver.
    """
    spark = edges.sparkSession
    links = stored(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct(), "links")
    parents: list[DataFrame] = []
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = stored(both.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p")), "parents")
        doubled = first
        for _ in range(2):
            up = doubled.select(F.col("a").alias("p"), F.col("p").alias("q"))
            doubled = doubled.join(up, "p").select("a", F.col("q").alias("p"))
        parent = stored(doubled, "parents")
        left = links.join(parent, "a").select(F.col("p").alias("pa"), F.col("b").alias("a"))
        left = left.join(parent, "a").select(F.greatest("pa", "p").alias("a"), F.least("pa", "p").alias("b"))
        after = stored(left.where("a <> b").distinct(), "links")
        dropped(first, links)
        parents.append(parent)
        links = after
    if not parents:
        return spark.createDataFrame([], "id long, component long")
    known = parents[0].select(F.col("a").alias("id"), F.col("p").alias("component"))
    for parent in parents[1:]:
        up = parent.select(F.col("a").alias("component"), "p")
        known = known.join(up, "component", "left").select("id", F.coalesce("p", "component").alias("component"))
    return known
