"""Session construction and lineage cuts.

The checkpoint folder comes from the cluster (``spark.checkpoint.dir``).  A
private folder is only created when nothing is configured and the master is
local, which is the test and bench situation.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, app: str = "logloom",
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a private one only for local masters."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="logloom-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def cut_lineage(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as a Parquet table under the shared checkpoint folder and
    read it back: one computation, short lineage, and the data survives the
    loss of any executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def cut_observed(df: DataFrame, name: str, **metrics) -> tuple[DataFrame, dict]:
    """``cut_lineage``, and the aggregates ``metrics`` (name=column) observed while the table is
    written, without a job of their own."""
    from pyspark.sql import Observation
    seen = Observation(f"{name}-{uuid.uuid4().hex[:8]}")
    out = cut_lineage(df.observe(seen, *[c.alias(n) for n, c in metrics.items()]), name)
    return out, seen.get


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the checkpoint folder for written intermediate tables."""
    base = checkpoint_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over the shuffle partitions: a scan has no more busy tasks than its files have row
    groups, however much work a row makes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def spread_if_idle(df: DataFrame) -> DataFrame:
    """``df``, spread only if its partitions that have rows would leave more than a third of the cores idle.

    Dealing whole texts over the tasks moves all of them; a scan of enough files or row groups is even as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    busy = df.select(F.spark_partition_id().alias("p")).distinct().count()
    waves = -(-busy // cores)
    return df if 3 * busy >= 2 * waves * cores and busy else spread(df)


def ranked(df: DataFrame, order: list[str], name: str, start: int = 1) -> DataFrame:
    """``df`` with the long column ``name``: start, start + 1, .. in the order of the columns ``order``.

    The rows are range-partitioned and sorted in their partitions; the driver
    gets the row count of each partition, and every row its offset plus its
    place.  No task sees more than its range."""
    rows = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    rows = cut_lineage(rows.withColumn("_mid", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_mid", 33)
    counts = sorted((r["p"], r["n"]) for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    offsets, at = {}, start
    for p, n in counts:
        offsets[p] = at
        at += n
    if not offsets:
        return rows.withColumn(name, F.lit(None).cast("long")).drop("_mid")
    lookup = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair])
    return rows.withColumn(name, (F.element_at(lookup, part) + F.col("_mid").bitwiseAND((1 << 33) - 1)).cast("long")).drop("_mid")
