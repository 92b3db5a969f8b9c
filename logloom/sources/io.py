"""Readers and writers.

Parquet is the main format; CSV and JSON lines are for interchange with the
files the reference reads and writes.  Everything read for scoring is read
as strings (A6).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.text import wildcards_to_placeholder

EXAMPLE_SCHEMA = "query string, answer string"


def read_structured(spark: SparkSession, path: str, fmt: str = "csv", columns=None) -> DataFrame:
    """A structured log or template table, every column a string;
    a missing EventTemplate becomes ``''``."""
    if fmt == "csv":
        df = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
              .option("inferSchema", False).csv(path))
    else:
        df = spark.read.parquet(path)
        df = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    if "EventTemplate" in df.columns:
        df = df.withColumn("EventTemplate", F.coalesce("EventTemplate", F.lit("")))
    return df.select(*columns) if columns else df


def write_structured(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                     partition_by=None) -> None:
    """Structured log, template table, corrected outputs and
    per-template classes."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    else:
        w.parquet(path)


def save_by_line(df: DataFrame, path: str, keys=("dataset", "LineId"), buckets: int | None = None) -> DataFrame:
    """Store a line table bucketed and sorted by its line key, and return it as read from there.

    Tables stored with the same number of buckets are aligned (C2) bucket by bucket, without a
    shuffle.  The table is external, at ``path``, and registered under a name of its own."""
    spark, keys = df.sparkSession, list(keys)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = "lines_" + uuid.uuid4().hex
    (df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).format("parquet").saveAsTable(name))
    return spark.table(name)


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Labelled examples, one JSON object per line."""
    return spark.read.schema(EXAMPLE_SCHEMA).json(path)


def write_examples(samples: DataFrame, path: str, placeholder: bool = True, mode: str = "overwrite") -> None:
    """A10: ``{query, answer}`` JSON lines; ``<*>`` -> ``{variables}`` unless
    ``placeholder`` is False."""
    ans = wildcards_to_placeholder(F.col("answer")) if placeholder else F.col("answer")
    samples.select("query", ans.alias("answer")).write.mode(mode).json(path)


def append_summary(summary: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append result rows (metrics, sampling statistics)."""
    write_structured(summary, path, fmt, mode="append")
