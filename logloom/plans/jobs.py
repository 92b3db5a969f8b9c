"""End-to-end jobs: files in, files out.

These are the runs a user performs: parse raw log files into a structured
log and a template table; score a parse against a truth file and append the
summary row; average and transpose the summary; sample labelled lines into
example files per shot.  Each is a composition of the DataFrame operators.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.text import correct_oracle_template
from logloom.operators import matching, metrics, sampling
from logloom.operators.correction import correct
from logloom.operators.discovery import parse
from logloom.sources import formats, io


def parse_files(spark: SparkSession, raw_paths, log_format: str, out_dir: str, dataset: str | None = None,
                templates: DataFrame | None = None, proposer=None, examples_path: str | None = None,
                k: int = 3, fmt: str = "parquet", selection_method: str = "jaccard") -> tuple[str, str]:
    """Raw log files -> ``out_dir/structured`` and ``out_dir/templates``."""
    lines = formats.read_raw_logs(spark, raw_paths, log_format)
    examples = None
    if examples_path:
        from pyspark.sql import Window
        ex = io.read_examples(spark, examples_path)
        examples = ex.withColumn("pos", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())))
    structured, _ = parse(lines, templates, proposer, examples, k, selection_method=selection_method)
    if dataset:
        structured = structured.withColumn("dataset", F.lit(dataset))
    s_path, t_path = os.path.join(out_dir, "structured"), os.path.join(out_dir, "templates")
    io.write_structured(structured, s_path, fmt)
    io.write_structured(matching.template_table(io.read_structured(spark, s_path, fmt)), t_path, fmt)  # not parsed again
    return s_path, t_path


def parse_systems(spark: SparkSession, root: str, out_dir: str, datasets, variant: str = "2k") -> tuple[str, str]:
    """Raw logs of registered systems (A16), each under ``root`` at its registered place and in its own format,
    parsed in one job -> ``out_dir/structured`` and ``out_dir/templates``, partitioned by dataset (A2, B1, P6, E1, A9).

    Every line keeps its headers in the map ``Headers``, as the systems' formats differ.  A system without an
    entry of this variant is an error."""
    places = {name: (place, log_format) for name, var, place, log_format in formats.LOG_FORMATS if var == variant}
    parts = []
    for name in datasets:
        place, log_format = places[name]
        lines = formats.read_raw_logs(spark, os.path.join(root, place), log_format)
        headers = [c for c in lines.columns if c not in ("LineId", "Content")]
        parts.append(lines.select(F.lit(name).alias("dataset"), "LineId", "Content",
                                  F.create_map(*[x for h in headers for x in (F.lit(h), F.col(h))]).alias("Headers")))
    structured, _ = parse(reduce(DataFrame.unionByName, parts), group_col="dataset")
    s_path, t_path = os.path.join(out_dir, "structured"), os.path.join(out_dir, "templates")
    io.write_structured(structured, s_path, partition_by="dataset")
    io.write_structured(matching.template_table(spark.read.parquet(s_path), group_cols=["dataset"]), t_path,
                        partition_by="dataset")
    return s_path, t_path


def correct_systems(spark: SparkSession, truth_paths: dict[str, str], out_dir: str, user_strings=None,
                    fmt: str = "csv") -> tuple[str, str, str]:
    """P10 for all systems in one job: structured truth logs (dataset -> path) corrected (G7, D22, C4) and written
    (A13) as ``structured_corrected``, ``templates_corrected`` and ``without_template`` (lines whose id is no
    template's) under ``out_dir``, partitioned by dataset."""
    read = [io.read_structured(spark, path, fmt).withColumn("dataset", F.lit(name)) for name, path in truth_paths.items()]
    truth = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), read)
    truth = truth.withColumn("LineId", F.col("LineId").cast("long"))
    tables = correct(truth, user_strings, ["dataset"])
    paths = tuple(os.path.join(out_dir, n) for n in ("structured_corrected", "templates_corrected", "without_template"))
    for table, path in zip(tables, paths):
        io.write_structured(table, path, fmt, partition_by="dataset")
    return paths


def classify_files(spark: SparkSession, truth_path: str, parsed_path: str, out_path: str, dataset: str,
                   fmt: str = "csv", parsed_fmt: str = "parquet") -> DataFrame:
    """Classes of the parsed templates of one system, written (A14) with the truth templates each of them meets;
    returns their shares (D13, D14, C2)."""
    def read(path, f):
        t = io.read_structured(spark, path, f).withColumn("dataset", F.lit(dataset))
        return t.withColumn("LineId", F.col("LineId").cast("long"))
    pairs = metrics.pair_counts(metrics.align(read(truth_path, fmt), read(parsed_path, parsed_fmt)))
    io.write_structured(metrics.template_classes(pairs), out_path)
    return metrics.class_shares(spark.read.parquet(out_path), pairs)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def evaluate_files(spark: SparkSession, truth_path: str, parsed_path: str, summary_path: str, dataset: str,
                   truth_templates_path: str | None = None, complexity: int = 0, frequent: int = 0,
                   relaxed: bool = False, fmt: str = "csv", parsed_fmt: str = "parquet",
                   corrected: bool = False, user_strings=None) -> DataFrame:
    """Score one parse and append its summary row (A5-A7, C2, D*, A11).

    ``complexity`` 1-3 or ``frequent`` (+n lowest / -n highest percent)
    restrict the scores to a band of the truth templates file.  ``corrected``
    scores against the oracle-corrected truth (G7).  A system without a parse
    gets a row of NULLs, so the summary of the others goes on."""
    if not _exists(spark, parsed_path):
        row = spark.createDataFrame([(dataset,)], "dataset string").select(
            "dataset", *[F.lit(None).cast("long").alias(c) for c in ("tool_templates", "ground_templates")],
            *[F.lit(None).cast("double").alias(c) for c in metrics.METRICS])
        io.append_summary(row.withColumn("load_order", F.unix_micros(F.current_timestamp())), summary_path)
        return row
    truth = io.read_structured(spark, truth_path, fmt).withColumn("dataset", F.lit(dataset))
    parsed = io.read_structured(spark, parsed_path, parsed_fmt).withColumn("dataset", F.lit(dataset))
    truth = truth.withColumn("LineId", F.col("LineId").cast("long"))
    parsed = parsed.withColumn("LineId", F.col("LineId").cast("long"))
    if corrected:
        truth = truth.withColumn("EventTemplate", correct_oracle_template(F.col("EventTemplate"), user_strings))
    pairs = metrics.pair_counts(metrics.align(truth, parsed))
    band = None
    if complexity or frequent:
        tt = io.read_structured(spark, truth_templates_path, fmt).withColumn("dataset", F.lit(dataset))
        tt = tt.withColumn("Occurrences", F.col("Occurrences").cast("long"))
        if corrected:
            tt = (tt.withColumn("EventTemplate", correct_oracle_template(F.col("EventTemplate"), user_strings))
                  .groupBy("dataset", "EventTemplate").agg(F.sum("Occurrences").alias("Occurrences")))
        band = metrics.complexity_band(tt, complexity) if complexity else \
            metrics.frequency_band(tt, frequent, ["dataset"])
    row = metrics.evaluate(pairs, band, relaxed=relaxed)
    row = row.select("dataset", "tool_templates", "ground_templates",
                     *[F.round(c, 3).alias(c) for c in metrics.METRICS])
    io.append_summary(row.withColumn("load_order", F.unix_micros(F.current_timestamp())), summary_path)
    return row


def summarize(spark: SparkSession, summary_path: str, out_path: str) -> DataFrame:
    """First row per dataset + Average, transposed, written as CSV."""
    s = spark.read.parquet(summary_path)
    avg = metrics.summary_with_average(s)
    t = metrics.transpose(avg)
    t.coalesce(1).write.mode("overwrite").option("header", True).csv(out_path)  # one row per metric
    return t


def sample_files(spark: SparkSession, labelled_path: str, out_dir: str, shots=sampling.SHOTS,
                 method: str = "hierarchical", share: float | None = 0.2, fmt: str = "csv",
                 stats_path: str | None = None) -> DataFrame:
    """Labelled structured log -> ``out_dir/<shot>shot`` example files (A10) and
    coverage statistics (D19, A17)."""
    lab = io.read_structured(spark, labelled_path, fmt)
    lab = lab.withColumn("row_id", F.col("LineId").cast("long"))
    if method == "farthest":
        samples = sampling.farthest_sample(lab, shots, share=share)
        placeholder = False
    else:
        samples = sampling.hierarchical_sample(lab, shots, share=share)
        samples = samples.withColumn("answer", F.col("template"))
        placeholder = True
    for shot in shots:
        io.write_examples(samples.filter(F.col("shot") == shot).orderBy("sample_pos"),
                          os.path.join(out_dir, f"{shot}shot"), placeholder=placeholder)
    stats = sampling.coverage(samples, lab, share)
    if stats_path:
        io.append_summary(stats, stats_path)
    return stats
