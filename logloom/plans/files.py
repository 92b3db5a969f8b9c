"""Registered queries that run the file jobs over several systems: the rendered log is dealt to three registered
systems, written in their formats, and read, parsed, corrected, scored and sampled from there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators import matching, metrics
from logloom.plans import jobs
from logloom.plans.catalog import SQL_SUMMARY_TRANSPOSED, _match_table
from logloom.plans.samples import SQL_SAMPLE_COVERAGE
from logloom.session import scratch_path
from logloom.sources import io
from logloom.sources.fixtures import RENDERED_SQL, rendered_events, table

SYSTEMS = ["Apache", "HealthApp", "Proxifier"]
_SYSTEM = "CASE (LineId - 1) % 3 WHEN 0 THEN 'Apache' WHEN 1 THEN 'HealthApp' ELSE 'Proxifier' END"
_RAW = {"Apache": "'[' || Date || ' ' || Time || '] [' || Level || '] ' || Content",
        "HealthApp": "Time || '|' || Component || '|' || cast(LineId as string) || '|' || Content",
        "Proxifier": "'[' || Date || ' ' || Time || '] ' || Component || ' - ' || Content"}
_PLACES = {name: f"{name}/{name}_2k.log" for name in SYSTEMS}
R = f"r AS ({RENDERED_SQL}), d AS (SELECT {_SYSTEM} AS dataset, * FROM r)"


def _parsed(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Three systems' raw logs written and parsed by ``jobs.parse_systems``."""
    root = scratch_path(spark, "systems")
    ev = rendered_events(spark, sf_dir)
    for name in SYSTEMS:
        lines = ev.filter(F.expr(_SYSTEM) == name).select("LineId", F.expr(_RAW[name]).alias("value"))
        lines.repartitionByRange("LineId").sortWithinPartitions("LineId").select("value").write.text(f"{root}/{_PLACES[name]}")
    return jobs.parse_systems(spark, root, root + "/out", SYSTEMS)


def parse_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16 + A1 + A2 + B1 + P6 + E1 + A9: three systems' logs, each in its registered format, parsed in one job;
    lines with headers as read back."""
    s = spark.read.parquet(_parsed(spark, sf_dir)[0])
    return s.select("dataset", F.col("LineId").cast("long").alias("LineId"), "EventId", "EventTemplate",
                    F.col("Headers")["Time"].alias("time"), F.col("Headers")["Component"].alias("component"))


SQL_PARSE_SYSTEMS = f"""
WITH {R},
n AS (SELECT dataset, expected, Date, Time, Component, LineId AS line, row_number() OVER (PARTITION BY dataset ORDER BY LineId) AS LineId FROM d),
f AS (SELECT dataset, expected, min(line) AS f FROM n GROUP BY ALL),
ids AS (SELECT dataset, expected, 'E' || cast(row_number() OVER (PARTITION BY dataset ORDER BY f, expected) AS varchar) AS EventId FROM f)
SELECT n.dataset, n.LineId, EventId, n.expected AS EventTemplate,
       CASE dataset WHEN 'HealthApp' THEN Time ELSE Date || ' ' || Time END AS time,
       CASE dataset WHEN 'HealthApp' THEN Component END AS component
FROM n JOIN ids USING (dataset, expected)
"""


def system_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9 + A7: the template files of three systems."""
    t = spark.read.parquet(_parsed(spark, sf_dir)[1])
    return t.select("dataset", "EventId", "EventTemplate", "Occurrences")


SQL_SYSTEM_TEMPLATES = f"""
WITH {R}, t AS (SELECT dataset, expected AS EventTemplate, count(*) AS Occurrences, min(LineId) AS f FROM d GROUP BY ALL)
SELECT dataset, 'E' || cast(row_number() OVER (PARTITION BY dataset ORDER BY f, EventTemplate) AS varchar) AS EventId,
       EventTemplate, Occurrences FROM t
"""


# ---------------------------------------------------------------------------
# Truth of all systems corrected
# ---------------------------------------------------------------------------

def _corrected(spark: SparkSession, sf_dir: str) -> tuple[str, str, str]:
    """Truth files of three systems (every fiftieth line nobody labelled) corrected by ``jobs.correct_systems``."""
    ev = rendered_events(spark, sf_dir).withColumn("dataset", F.expr(_SYSTEM))
    truth = F.when(F.col("event_type").isin("error", "view"), F.col("Content")).otherwise(F.col("gt"))
    s = ev.select("dataset", "LineId", "Content", F.when(F.col("LineId") % 50 != 0, truth).alias("EventTemplate"))
    labelled = matching.assign_event_ids(s.filter("EventTemplate is not null"), "EventTemplate", "LineId", ["dataset"])
    s = labelled.unionByName(s.filter("EventTemplate is null"), allowMissingColumns=True)
    base, paths = scratch_path(spark, "truth"), {}
    io.write_structured(s, base + "/all", "csv", partition_by="dataset")
    for name in SYSTEMS:
        paths[name] = f"{base}/all/dataset={name}"
    return jobs.correct_systems(spark, paths, base + "/corrected")


def correct_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10 + G7 + D22 + C4 + A13: the corrected structured logs of three systems as read back."""
    s = io.read_structured(spark, _corrected(spark, sf_dir)[0], "csv")
    return s.select("dataset", F.col("LineId").cast("long").alias("LineId"), "EventId", "EventTemplate")


def corrected_system_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10 + E9 + A13: the corrected template files of three systems as read back."""
    t = io.read_structured(spark, _corrected(spark, sf_dir)[1], "csv")
    return t.select("dataset", "EventId", "EventTemplate", F.col("pos").cast("int").alias("pos"))


def lines_without_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10 + C4: the lines of three systems whose id is no template's, as read back."""
    r = spark.read.option("header", True).option("escape", '"').csv(_corrected(spark, sf_dir)[2])
    return r.select("dataset", F.col("LineId").cast("long").alias("LineId"), "Content")


_SQL_TRUTH = """
s AS (SELECT dataset, LineId, gt AS c, CASE WHEN event_type IN ('error', 'view') THEN Content ELSE gt END AS t FROM d WHERE LineId % 50 <> 0),
f AS (SELECT dataset, t, any_value(c) AS c, min(LineId) AS fl FROM s GROUP BY dataset, t),
ids AS (SELECT *, 'E' || cast(row_number() OVER (PARTITION BY dataset ORDER BY fl, t) AS varchar) AS EventId FROM f),
m AS (SELECT dataset, c, min(EventId) AS new_id FROM ids GROUP BY dataset, c)
"""
SQL_CORRECT_SYSTEMS = f"""WITH {R}, {_SQL_TRUTH}
SELECT dataset, LineId, new_id AS EventId, c AS EventTemplate FROM s JOIN m USING (dataset, c)
UNION ALL SELECT dataset, LineId, NULL, '' FROM d WHERE LineId % 50 = 0"""
SQL_CORRECTED_SYSTEM_TEMPLATES = f"""WITH {R}, {_SQL_TRUTH}
SELECT dataset, new_id AS EventId, c AS EventTemplate,
       CAST(row_number() OVER (PARTITION BY dataset ORDER BY cast(substr(new_id, 2) AS BIGINT), new_id) AS INTEGER) AS pos FROM m"""
SQL_LINES_WITHOUT_TEMPLATE = f"WITH {R} SELECT dataset, LineId, Content FROM d WHERE LineId % 50 = 0"


# ---------------------------------------------------------------------------
# Files of scores, classes and samples
# ---------------------------------------------------------------------------

def _truth_files(spark: SparkSession, sf_dir: str) -> str:
    """Truth of three systems as CSV, with the line numbers of their own files."""
    ev = rendered_events(spark, sf_dir).withColumn("dataset", F.expr(_SYSTEM))
    path = scratch_path(spark, "truth")
    io.write_structured(ev.select("dataset", F.expr("(LineId - 1) DIV 3 + 1").alias("LineId"), "Content",
                                  F.col("gt").alias("EventTemplate")), path, "csv", partition_by="dataset")
    return path


def summary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11 + A12 + B12 + C2 + D21 + P7: three systems scored against their truth files, a summary row each, the
    averaged and transposed report as read back."""
    parsed, truth = _parsed(spark, sf_dir)[0], _truth_files(spark, sf_dir)
    base = scratch_path(spark, "summary")
    for name in SYSTEMS:
        jobs.evaluate_files(spark, f"{truth}/dataset={name}", f"{parsed}/dataset={name}", base + "/rows", name)
    jobs.summarize(spark, base + "/rows", base + "/report")
    report = spark.read.option("header", True).option("inferSchema", True).csv(base + "/report")
    return report.filter(F.col("metric").isin(*metrics.METRICS)).select(
        "metric", *[F.col(c).cast("double").alias(c) for c in ["Average", *SYSTEMS]])


def class_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14 + D13 + C9: the class file of one system's parsed templates as read back."""
    parsed, truth = _parsed(spark, sf_dir)[0], _truth_files(spark, sf_dir)
    out = scratch_path(spark, "classes")
    jobs.classify_files(spark, f"{truth}/dataset=Apache", f"{parsed}/dataset=Apache", out, "Apache")
    c = spark.read.parquet(out)
    return c.select("dataset", "identified_template", "type", "num_messages",
                    F.array_join("corr_oracle_templates", " | ").alias("truth_templates"))


def sample_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17 + A10 + D19: example files of all shots from a labelled file, and the statistics appended beside them."""
    d = table(spark, sf_dir, "documents", ["doc_id", "text", "source"])
    base = scratch_path(spark, "sampling")
    io.write_structured(d.select((F.col("doc_id") + 1).alias("LineId"), F.col("text").alias("Content"),
                                 F.col("source").alias("EventTemplate")), base + "/labelled")
    jobs.sample_files(spark, base + "/labelled", base + "/examples", share=None, fmt="parquet", stats_path=base + "/stats")
    return spark.read.parquet(base + "/stats").select("shot", "covered", "n_templates", "coverage")


def saved_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines stored with the id of their template and templates stored apart, put together again."""
    ev = rendered_events(spark, sf_dir)
    base, templates = scratch_path(spark, "saved"), _match_table(ev, "view")
    io.write_structured(templates, base + "/templates")
    stored = spark.read.parquet(base + "/templates")
    matched = matching.match_messages(ev.select("LineId", "Content"), stored)
    io.write_structured(matched.select("LineId", "template_id"), base + "/lines")
    return matching.attach_templates(spark.read.parquet(base + "/lines"), stored).select("LineId", "EventTemplate")


SQL_SUMMARY_FILES = SQL_SUMMARY_TRANSPOSED
for _i, _name in enumerate(SYSTEMS):
    SQL_SUMMARY_FILES = SQL_SUMMARY_FILES.replace(f"AS part{_i}", f'AS "{_name}"')

SQL_CLASS_FILES = f"""
WITH {R}, p AS (SELECT expected AS parsed, gt, count(*) AS n FROM d WHERE dataset = 'Apache' GROUP BY ALL),
c AS (SELECT parsed, count(*) AS k, any_value(gt) AS gt1, CAST(sum(n) AS BIGINT) AS num_messages, string_agg(gt, ' | ' ORDER BY gt) AS truth_templates FROM p GROUP BY parsed),
rx AS (SELECT *, '^' || replace(regexp_escape(replace(gt1, '<*>', chr(31))), regexp_escape(chr(31)), '\\S+?') || '$' AS gt_rx,
              '^' || replace(regexp_escape(replace(parsed, '<*>', chr(31))), regexp_escape(chr(31)), '\\S+?') || '$' AS parsed_rx FROM c)
SELECT 'Apache' AS dataset, parsed AS identified_template,
       CASE WHEN k = 1 AND gt1 = parsed THEN 'SM' WHEN k > 1 THEN 'MX' WHEN regexp_matches(gt1, parsed_rx) THEN 'OG'
            WHEN regexp_matches(parsed, gt_rx) THEN 'UG' ELSE 'MX' END AS type, num_messages, truth_templates
FROM rx
"""
SQL_SAVED_TEMPLATES = f"""
WITH r AS ({RENDERED_SQL})
SELECT LineId, CASE event_type WHEN 'signup' THEN '<*> session opened' WHEN 'view' THEN NULL ELSE expected END AS EventTemplate FROM r
"""

QUERIES = {
    "parse_systems": (parse_systems, SQL_PARSE_SYSTEMS),
    "system_templates": (system_templates, SQL_SYSTEM_TEMPLATES),
    "correct_systems": (correct_systems, SQL_CORRECT_SYSTEMS),
    "corrected_system_templates": (corrected_system_templates, SQL_CORRECTED_SYSTEM_TEMPLATES),
    "lines_without_template": (lines_without_template, SQL_LINES_WITHOUT_TEMPLATE),
    "summary_files": (summary_files, SQL_SUMMARY_FILES),
    "class_files": (class_files, SQL_CLASS_FILES),
    "sample_statistics": (sample_statistics, SQL_SAMPLE_COVERAGE),
    "saved_templates": (saved_templates, SQL_SAVED_TEMPLATES),
}
