"""Online parsing with Structured Streaming.

The templates and their numbers (E1, fixed at birth) are the state.  Every
micro-batch (``foreachBatch``):

1. reads the state left by the batches before it: the latest snapshot and the
   changes since then;
2. runs the discovery job (match, propose, add, match again) on the batch;
3. writes the batch's structured rows with their EventId, then what the batch
   changed: templates added and replaced, numbers given.

Every ``COMPACT_EVERY`` batches the whole state is written as a snapshot, so a
batch reads few tables however long the stream runs, and writes no more
than it changed.  Writes overwrite their batch folder, and a batch reads
only what batches before it wrote, so a batch that is replayed after a failure
produces the same files (idempotent per ``batch_id``).  The stream's checkpoint records
which input files were consumed, so a restarted query resumes after the last
committed batch without repeating a line.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators.discovery import parse
from logloom.session import cut_lineage

LINE_SCHEMA = "LineId long, Content string"


#: Batches after which the whole state is written anew.
COMPACT_EVERY = 10
#: A state table's row: a template added (``add``) or replaced (``drop``), or the number of one (``id``).
STATE_COLUMNS = {"op": "string", "template_id": "long", "template": "string", "number": "long"}


def _committed(spark: SparkSession, root_dir: str, prefix: str, before: int) -> list[int]:
    """Numbers below ``before`` of the folders ``prefix=number`` with a commit mark, latest first."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(root_dir)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    ids = sorted((int(n.partition("=")[2]) for n in names if n.startswith(prefix + "=")), reverse=True)
    return [b for b in ids if b < before and fs.exists(jvm.org.apache.hadoop.fs.Path(root, f"{prefix}={b}/_SUCCESS"))]


def load_state(spark: SparkSession, state_dir: str, before: int, group_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(templates, numbers) that the committed batches before ``before`` left.

    Only the latest snapshot and the batches after it are read; a folder that can't be read is an
    error, not an empty state.  A batch table of templates alone (no column ``op``) is a whole state."""
    G = [group_col] if group_col else []
    schema = ", ".join(f"{c} {t}" for c, t in STATE_COLUMNS.items()) + "".join(f", {g} string" for g in G)
    state = spark.createDataFrame([], schema)
    snapshot = (_committed(spark, state_dir, "snapshot_id", before) or [-1])[0]
    for b in _committed(spark, state_dir, "batch_id", before):
        if b <= snapshot:
            break
        part = spark.read.parquet(os.path.join(state_dir, f"batch_id={b}"))
        if "op" not in part.columns:
            state = state.unionByName(part.withColumn("op", F.lit("add")), allowMissingColumns=True)
            snapshot = -1
            break
        state = state.unionByName(part)
    if snapshot >= 0:
        state = state.unionByName(spark.read.parquet(os.path.join(state_dir, f"snapshot_id={snapshot}")))
    gone = state.filter(F.col("op") == "drop").select("template_id")
    templates = state.filter(F.col("op") == "add").join(gone, "template_id", "left_anti").select("template_id", "template", *G)
    return templates, state.filter(F.col("op") == "id").select(*G, F.col("template").alias("EventTemplate"), "number")


def _latest_state(spark: SparkSession, state_dir: str, before: int, group_col: str | None = None) -> DataFrame:
    """The templates of ``load_state``."""
    return load_state(spark, state_dir, before, group_col)[0]


def _state_rows(templates: DataFrame, op: str, G: list[str]) -> DataFrame:
    return templates.select(F.lit(op).alias("op"), "template_id", "template", F.lit(None).cast("long").alias("number"), *G)


def _number_rows(numbers: DataFrame, G: list[str]) -> DataFrame:
    return numbers.select(F.lit("id").alias("op"), F.lit(None).cast("long").alias("template_id"), F.col("EventTemplate").alias("template"), "number", *G)


def parse_batch(batch: DataFrame, batch_id: int, out_dir: str, state_dir: str,
                proposer=None, examples=None, group_col: str | None = None, answers_dir: str | None = None) -> None:
    spark = batch.sparkSession
    G = [group_col] if group_col else []
    templates, numbers = load_state(spark, state_dir, batch_id, group_col)
    templates, numbers = cut_lineage(templates, "state-templates"), cut_lineage(numbers, "state-numbers")
    new: list[DataFrame] = []
    structured, T = parse(batch, templates, proposer, examples, group_col=group_col, answers_dir=answers_dir, known_ids=numbers, ids_out=new)
    structured.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(os.path.join(out_dir, f"batch_id={batch_id}"))
    change = (_state_rows(T.join(templates, "template_id", "left_anti"), "add", G)
              .unionByName(_state_rows(templates.join(T, "template_id", "left_anti"), "drop", G)).unionByName(_number_rows(new[0], G)))
    change.coalesce(1).write.mode("overwrite").parquet(os.path.join(state_dir, f"batch_id={batch_id}"))
    if batch_id % COMPACT_EVERY == COMPACT_EVERY - 1:
        whole = _state_rows(T, "add", G).unionByName(_number_rows(numbers.unionByName(new[0]), G))
        whole.write.mode("overwrite").parquet(os.path.join(state_dir, f"snapshot_id={batch_id}"))


def start(spark: SparkSession, source_dir: str, out_dir: str, state_dir: str, checkpoint: str,
          files_per_trigger: int = 1, available_now: bool = True, proposer=None, examples=None,
          group_col: str | None = None, answers_dir: str | None = None):
    """Start the online parse over Parquet files of ``LineId, Content``
    (plus ``group_col`` when many datasets share the stream)."""
    schema = LINE_SCHEMA + (f", {group_col} string" if group_col else "")
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
              .parquet(source_dir))
    w = (stream.writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(lambda df, bid: parse_batch(df, bid, out_dir, state_dir, proposer, examples, group_col, answers_dir)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def read_output(spark: SparkSession, out_dir: str, group_col: str | None = None) -> DataFrame:
    """Structured log written by the stream; the E1 ids are those each template got at its birth."""
    return spark.read.parquet(out_dir)
