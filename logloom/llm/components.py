"""Connected components of a link table, by DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(id, root) for every id in ``links`` (a, b: long); root is the smallest id its links reach.

    Large-star and small-star steps in turn: each id's neighbours are linked to the
    smallest one instead.  An id with very many neighbours is aggregated before it
    is shuffled, and joined to a single row, which adaptive execution can split.
    Every pair of steps is written to the shared folder; only counts and a checksum of the
    links reach the driver.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))).distinct()
        edges = written(small, name, keep_shuffles=True)
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (now.n, now.x) == state:
            break
        state = (now.n, now.x)
    found = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return found.union(found.select(F.col("root").alias("id"), "root").distinct())
