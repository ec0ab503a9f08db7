"""Ordered computation inside groups that may outgrow one task.

A Spark window keeps a whole group in one task.  That is the best plan while groups are
small, and a dead end when one packet holds a large share of all rows.  Every ordered
operator of the library therefore goes through ``scan``:

* groups within ``group_limit`` rows (measured once, or proven by the caller) use plain
  windows: one shuffle on the group keys, shared by every following scan;
* otherwise a group is cut into chunks of at most ``group_limit`` consecutive positions.
  Windows run inside (group, chunk), one summary row per chunk carries state over to
  the later chunks, and both are joined on (group, chunk).  Results are the same.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GROUP_LIMIT_KEY = "spark.quire.groupLimit"
DEFAULT_GROUP_LIMIT = 1 << 20
TASK_ROWS_KEY = "spark.quire.taskRows"
DEFAULT_TASK_ROWS = 1 << 18


def group_limit(spark: SparkSession) -> int:
    """Rows of one group that a single task may sort."""
    return int(spark.conf.get(GROUP_LIMIT_KEY, str(DEFAULT_GROUP_LIMIT)))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; a private one only where the session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/quire-{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder; a lost executor costs no replay.

    A written table rather than ``checkpoint``: the next step gets true sizes to plan with,
    reads only the columns it needs, and does not carry the constraints of all earlier rounds.
    """
    path = scratch_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exceeds_group_limit(df: DataFrame, keys: list[str], table: bool = False) -> bool:
    """Whether any group is too large for one task; counts are combined before the shuffle.

    ``table`` says that ``df`` is a stored table: its row count comes from the file footers,
    and a table within the limit needs no look at its groups.
    """
    limit = group_limit(df.sparkSession)
    if table and df.count() <= limit:
        return False
    return not large_groups(df, keys, limit).isEmpty()


def task_count(spark: SparkSession, rows: int) -> int | None:
    """Tasks over which so many rows are spread; None where the session's cores need no more tasks than they are.

    A number of partitions that stays while tables grow, as a session fixes it, lets every sort and window grow with them.
    """
    tasks = -(-rows // int(spark.conf.get(TASK_ROWS_KEY, str(DEFAULT_TASK_ROWS))))
    return tasks if tasks > spark.sparkContext.defaultParallelism else None


def spread(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` over ``tasks`` tasks; windows, groups and joins on these keys follow."""
    return df.repartition(tasks, *keys) if tasks else df


def large_groups(df: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Keys of the groups with more than ``limit`` rows."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return counts.filter(F.col("_rows") > limit).select(*keys)


@dataclass(frozen=True)
class RunningSum:
    """Sum of ``value`` over the rows up to this one (or strictly before it)."""

    out: str
    value: Column
    inclusive: bool = True

    def plain(self, keys, order):
        window = Window.partitionBy(*keys).orderBy(*order)
        window = window.rowsBetween(Window.unboundedPreceding, 0 if self.inclusive else -1)
        return F.coalesce(F.sum(self.value).over(window), F.lit(0))

    def summary(self, order):
        return F.sum(self.value)

    def carry(self, column, keys, chunk):
        window = Window.partitionBy(*keys).orderBy(chunk)
        return F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1))

    inner = plain

    def merge(self, inner, carried):
        return inner + F.coalesce(carried, F.lit(0))


@dataclass(frozen=True)
class CarryLast:
    """The nearest non-null ``value`` among the rows before this one (or up to it)."""

    out: str
    value: Column
    inclusive: bool = False

    def plain(self, keys, order):
        window = Window.partitionBy(*keys).orderBy(*order)
        window = window.rowsBetween(Window.unboundedPreceding, 0 if self.inclusive else -1)
        return F.last(self.value, ignorenulls=True).over(window)

    def summary(self, order):
        place = F.when(self.value.isNotNull(), F.struct(*order))
        return F.max_by(self.value, place)

    def carry(self, column, keys, chunk):
        window = Window.partitionBy(*keys).orderBy(chunk)
        window = window.rowsBetween(Window.unboundedPreceding, -1)
        return F.last(column, ignorenulls=True).over(window)

    inner = plain

    def merge(self, inner, carried):
        return F.coalesce(inner, carried)


@dataclass(frozen=True)
class Previous:
    """``value`` of the row just before this one, null included."""

    out: str
    value: Column

    def _boxed(self):
        return F.struct(self.value.alias("v"))

    def plain(self, keys, order):
        return F.lag(self.value).over(Window.partitionBy(*keys).orderBy(*order))

    def inner(self, keys, order):
        return F.lag(self._boxed()).over(Window.partitionBy(*keys).orderBy(*order))

    def summary(self, order):
        return F.max_by(self._boxed(), F.struct(*order))

    def carry(self, column, keys, chunk):
        return F.lag(column).over(Window.partitionBy(*keys).orderBy(chunk))

    def merge(self, inner, carried):
        return F.coalesce(inner, carried)["v"]


@dataclass(frozen=True)
class Following:
    """``value`` of the row just after this one, null included."""

    out: str
    value: Column

    def _boxed(self):
        return F.struct(self.value.alias("v"))

    def plain(self, keys, order):
        return F.lead(self.value).over(Window.partitionBy(*keys).orderBy(*order))

    def inner(self, keys, order):
        return F.lead(self._boxed()).over(Window.partitionBy(*keys).orderBy(*order))

    def summary(self, order):
        return F.min_by(self._boxed(), F.struct(*order))

    def carry(self, column, keys, chunk):
        return F.lead(column).over(Window.partitionBy(*keys).orderBy(chunk))

    def merge(self, inner, carried):
        return F.coalesce(inner, carried)["v"]


@dataclass(frozen=True)
class GroupFirst:
    """The first non-null ``value`` of the whole group."""

    out: str
    value: Column

    def plain(self, keys, order):
        window = Window.partitionBy(*keys).orderBy(*order)
        window = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return F.first(self.value, ignorenulls=True).over(window)

    def inner(self, keys, order):
        return F.lit(None)

    def summary(self, order):
        place = F.when(self.value.isNotNull(), F.struct(*order))
        return F.min_by(self.value, place)

    def carry(self, column, keys, chunk):
        window = Window.partitionBy(*keys).orderBy(chunk)
        window = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return F.first(column, ignorenulls=True).over(window)

    def merge(self, inner, carried):
        return carried


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null, as windows and groups take it; the left keys stay."""
    other = right.withColumnsRenamed({key: f"_join_{i}" for i, key in enumerate(keys)})
    match = reduce(and_, [left[key].eqNullSafe(other[f"_join_{i}"]) for i, key in enumerate(keys)])
    return left.join(other, match, how).drop(*[f"_join_{i}" for i in range(len(keys))])


def scan(df: DataFrame, keys: list[str], order: list[str], specs: list, split: bool | None = None) -> DataFrame:
    """Add one column per spec, computed over each group in ``order``.

    ``order[0]`` is an integral position that few rows of a group share; the remaining
    columns break its ties.  ``split`` says whether some group exceeds the limit; None measures.
    """
    if split is None:
        split = exceeds_group_limit(df, keys)
    kept = [F.col(name) for name in df.columns]
    if not split:
        return df.select(*kept, *[spec.plain(keys, order).alias(spec.out) for spec in specs])
    width = group_limit(df.sparkSession)
    chunked = df.withColumn("_scan_chunk", F.expr(f"`{order[0]}` div {width}"))
    cell = [*keys, "_scan_chunk"]
    summary = chunked.groupBy(*cell).agg(
        *[spec.summary(order).alias(f"_scan_s{i}") for i, spec in enumerate(specs)]
    )
    carried = durable(
        summary.select(
            *cell,
            *[spec.carry(F.col(f"_scan_s{i}"), keys, "_scan_chunk").alias(f"_scan_c{i}") for i, spec in enumerate(specs)],
        )
    )
    inner = chunked.select("*", *[spec.inner(cell, order).alias(f"_scan_i{i}") for i, spec in enumerate(specs)])
    merged = join_null_safe(inner, carried, cell, "left")
    return merged.select(
        *kept,
        *[spec.merge(F.col(f"_scan_i{i}"), F.col(f"_scan_c{i}")).alias(spec.out) for i, spec in enumerate(specs)],
    )


def with_positions(
    df: DataFrame, keys: list[str], order: list, out: str = "pos", split: bool | None = None
) -> DataFrame:
    """Number the rows of each group 1, 2, ... in a unique total ``order`` (columns or names)."""
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    if split is None:
        split = exceeds_group_limit(df, keys)
    if not split:
        window = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(out, F.row_number().over(window).cast("bigint"))
    # Sort everything by range, then offset each run of a group by its runs in earlier
    # partitions.  The checkpoint pins the sampled range bounds.
    sorted_rows = df.repartitionByRange(*[F.col(k) for k in keys], *order).sortWithinPartitions(
        *[F.col(k) for k in keys], *order
    )
    stamped = durable(
        sorted_rows.withColumn("_run_part", F.spark_partition_id()).withColumn("_run_row", F.monotonically_increasing_id())
    )
    runs = stamped.groupBy(*keys, "_run_part").agg(F.min("_run_row").alias("_run_first"), F.count(F.lit(1)).alias("_run_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_run_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(*keys, "_run_part", "_run_first", F.coalesce(F.sum("_run_rows").over(earlier), F.lit(0)).alias("_run_before"))
    return join_null_safe(stamped, starts, [*keys, "_run_part"]).select(
        *df.columns, (F.col("_run_row") - F.col("_run_first") + F.col("_run_before") + 1).cast("bigint").alias(out)
    )


def islands(
    df: DataFrame, keys: list[str], order: list[str], previous: dict[str, Column], breaks, out: str = "island",
    split: bool | None = None,
) -> DataFrame:
    """Number maximal runs of adjacent rows: ``breaks(prev)`` is true where a run starts.

    ``previous`` names the values of the preceding row that the rule looks at; ``breaks``
    receives them as a struct column that is null on the first row of a group.
    """
    if split is None:
        split = exceeds_group_limit(df, keys)
    boxed = F.struct(*[value.alias(name) for name, value in previous.items()])
    looked = scan(df, keys, order, [Previous("_island_prev", boxed)], split)
    prev = F.col("_island_prev")
    starts = F.when(prev.isNull() | breaks(prev), 1).otherwise(0)
    return scan(looked, keys, order, [RunningSum(out, starts)], split).drop("_island_prev")


def nest_rows(
    df: DataFrame, keys: list[str], position: str, fields: list[str], out: str, slice_rows: int = 100_000
) -> DataFrame:
    """Collect ordered rows into arrays of at most ``slice_rows`` positions.

    ``position`` is dense within the group, starting at 1; slice 0 is the only slice
    of a group within the limit, so nothing is cut off and no array is unbounded.
    """
    sliced = df.withColumn("slice", F.expr(f"(`{position}` - 1) div {slice_rows}"))
    row = F.struct(position, *[name for name in fields if name != position])
    return sliced.groupBy(*keys, "slice").agg(F.array_sort(F.collect_list(row)).alias(out))
