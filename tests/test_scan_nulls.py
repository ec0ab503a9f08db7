"""Both paths of ordered scans give the same rows, null keys included."""

import pytest
from pyspark.sql import functions as F

from quire.operators.scan import GroupFirst, Previous, RunningSum, islands, scan, with_positions

ROWS = [(g, k, (k * 7) % 5) for g in ("a", "b") for k in range(12)] + [(None, k, k) for k in range(9)] + [("c", 0, 1)]


@pytest.mark.parametrize("keys", [["g"], ["g", "h"]])
def test_the_split_path_keeps_null_keys(spark, keys):
    frame = spark.createDataFrame(ROWS, "g string, pos long, v long").withColumn("h", F.when(F.col("pos") >= 0, F.lit(None).cast("int")))
    specs = [RunningSum("total", F.col("v")), Previous("before", F.col("v")), GroupFirst("first", F.col("v"))]
    spark.conf.set("spark.quire.groupLimit", "3")
    try:
        for run in (
            lambda split: scan(frame, keys, ["pos"], specs, split), lambda split: with_positions(frame, keys, [F.col("v"), F.col("pos")], "n", split),
            lambda split: islands(frame, keys, ["pos"], {"v": F.col("v")}, lambda p: p["v"] > F.col("v"), "run", split),
        ):
            rows = [sorted(map(str, run(split).collect())) for split in (False, True)]
            assert len(rows[0]) == len(ROWS) and rows[0] == rows[1]
    finally:
        spark.conf.unset("spark.quire.groupLimit")
