"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python task turns into Python objects at a time.
ROWS_AT_A_TIME = 256
#: Bytes of text that a Python task turns into Python objects at a time (one longer text goes alone).
BYTES_AT_A_TIME = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared folder of ``spark.checkpoint.dir``, as a full URI."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        from logloom.session import checkpoint_dir
        base = checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, keep_shuffles: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, short
    lineage, and it survives the loss of any executor.  The shuffle files behind
    it are needed no more; a collection of the driver's garbage lets Spark's
    cleaner delete them now (``keep_shuffles``: whenever it comes)."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    if not keep_shuffles:
        df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def collected(spark: SparkSession) -> int:
    """Let the executors' JVMs collect their garbage, so that heap they hold but don't use goes back to the system
    before Python workers need it.  Returns the number of tasks that asked for it (twice as many as run at once,
    so that each executor gets some)."""
    n = 2 * spark.sparkContext.defaultParallelism
    return spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')").alias("asked")).where("asked is not null").count()


#: The columns of ``documents``, which stages work with; all others pass by them.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def guarded(stage):
    """A pipeline stage whose working columns can't clash with those of its input: further columns
    of the documents travel in one struct column with a name that no column has."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = [c for c in docs.columns if c in DOCUMENT_COLUMNS]
        more = [c for c in docs.columns if c not in DOCUMENT_COLUMNS]
        if not more:
            return stage(spark, docs, sf_dir)
        name = f"others_{uuid.uuid4().hex}"
        quoted = {c: "`" + c.replace("`", "``") + "`" for c in docs.columns}
        packed = docs.select(*own, F.struct(*[F.col(quoted[c]).alias(f"c{i}") for i, c in enumerate(more)]).alias(name))
        out = stage(spark, packed, sf_dir)
        return out.select(*[F.col(c) if c in own else F.col(name)[f"c{more.index(c)}"].alias(c) for c in docs.columns])
    return run


def held_out(key: Column) -> Column:
    """True for the fold that no label is learnt from: crc32 of the key as text mod 4 is 2."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], text: str | None = None, rows: int = ROWS_AT_A_TIME) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that few rows, and few bytes of column ``text``, are Python objects at once."""
    for batch in batches:
        lo, n = 0, batch.num_rows
        lengths = None
        if text is not None and n:
            lengths = np.nan_to_num(pc.binary_length(batch.column(batch.schema.get_field_index(text))).to_numpy(zero_copy_only=False).astype(float))
        while lo < n:
            hi = min(n, lo + rows)
            if lengths is not None:
                total = np.cumsum(lengths[lo:hi])
                hi = lo + max(1, int(np.searchsorted(total, BYTES_AT_A_TIME)))
                hi = min(hi, n, lo + rows)
            yield batch.slice(lo, hi - lo)
            lo = hi


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
