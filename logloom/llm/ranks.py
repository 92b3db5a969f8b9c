"""Consecutive numbers over a whole table, without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with the long column ``name``: 0, 1, .. in the order of the columns ``order`` (nulls first).

    Rows are dealt by ranges and sorted in their partitions; each gets the number of rows in
    the partitions before its own (one row for each partition, broadcast) and its place there."""
    rows = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    rows = written(rows.withColumn("_mid", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_mid", 33)
    counts = sorted((r.p, r.n) for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for p, n in counts:
        before.append((p, total))
        total += n
    bases = df.sparkSession.createDataFrame(before, "_part long, _base long")
    rows = rows.withColumn("_part", part).join(F.broadcast(bases), "_part")
    return rows.withColumn(name, F.col("_base") + F.col("_mid").bitwiseAND((1 << 33) - 1)).drop("_mid", "_part", "_base")
