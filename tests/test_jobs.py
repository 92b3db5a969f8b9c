"""End-to-end file jobs on the rendered log."""
import tempfile

from pyspark.sql import functions as F

from logloom.plans import jobs
from logloom.sources import io
from logloom.sources.fixtures import EVENTS_FORMAT, rendered_events


def test_parse_evaluate_summarize_sample(spark, sf):
    d = tempfile.mkdtemp(prefix="logloom-jobs-")
    ev = rendered_events(spark, sf)
    ev.repartitionByRange(3, "LineId").sortWithinPartitions("LineId").select(F.col("raw").alias("value")) \
        .write.text(d + "/raw")
    truth = ev.select("LineId", "Content", F.col("gt").alias("EventTemplate"))
    io.write_structured(truth.withColumn("EventId", F.lit("x")), d + "/truth", "csv")
    tt = ev.groupBy(F.col("gt").alias("EventTemplate")).agg(F.count("*").alias("Occurrences"))
    io.write_structured(tt, d + "/truth_templates", "csv")

    s_path, t_path = jobs.parse_files(spark, d + "/raw", EVENTS_FORMAT, d + "/out")
    row = jobs.evaluate_files(spark, d + "/truth", s_path, d + "/summary", "events").first()
    n = ev.count()
    not_click = ev.filter(F.col("event_type") != "click").count()
    ok_text = ev.filter(~F.col("event_type").isin("click", "view")).count()
    assert row["GA"] == round(not_click / n, 3) and row["PA"] == round(ok_text / n, 3)
    assert row["tool_templates"] == 7 and row["ground_templates"] == 6
    band = jobs.evaluate_files(spark, d + "/truth", s_path, d + "/summary", "events_band",
                               d + "/truth_templates", complexity=3).first()
    assert band["GA"] is None
    t = {r["metric"]: r for r in jobs.summarize(spark, d + "/summary", d + "/report").collect()}
    assert t["GA"]["events"] == row["GA"]

    lab = ev.select("LineId", "Content", F.col("gt").alias("EventTemplate"))
    io.write_structured(lab, d + "/labelled", "csv")
    stats = jobs.sample_files(spark, d + "/labelled", d + "/examples", shots=[8, 16], share=None)
    assert sorted(r["shot"] for r in stats.collect()) == [8, 16]
    assert io.read_examples(spark, d + "/examples/8shot").count() == 8


def test_systems_in_their_own_formats(spark, tmp_path):
    """Each registered system is read by its own format; headers are kept; ids start anew in each system."""
    raw = {"Apache": ["[Sun Dec 04] [notice] worker 12 ready", "[Sun Dec 04] [error] no route to 10.0.0.1",
                      "not a log line", "[Sun Dec 05] [notice] worker 15 ready"],
           "HealthApp": ["20171223|Step|30002312|worker 77 ready"]}
    for name, lines in raw.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}_2k.log").write_text("\n".join(lines) + "\n")
    s_path, t_path = jobs.parse_systems(spark, str(tmp_path), str(tmp_path / "out"), list(raw))
    got = {(r["dataset"], r["LineId"]): r for r in spark.read.parquet(s_path).collect()}
    assert set(got) == {("Apache", 1), ("Apache", 2), ("Apache", 3), ("HealthApp", 1)}
    assert got["Apache", 3]["EventTemplate"] == got["HealthApp", 1]["EventTemplate"] == "worker <*> ready"
    assert got["Apache", 3]["EventId"] == got["HealthApp", 1]["EventId"] == "E1" and got["Apache", 2]["EventId"] == "E2"
    assert got["Apache", 2]["Headers"] == {"Time": "Sun Dec 04", "Level": "error"}
    assert got["HealthApp", 1]["Headers"]["Component"] == "Step"
    assert spark.read.parquet(t_path).count() == 3


def test_truth_of_systems_corrected_and_classified(spark, tmp_path):
    """P10: equal templates merge inside a system only; lines nobody labelled are reported and make no template."""
    cols = "LineId long, Content string, EventId string, EventTemplate string"
    a = [(1, "user 7 in", "E10", "user 7 in"), (2, "user 8 in", "E2", "user <*> in"), (3, "odd", None, None)]
    b = [(1, "user 9 in", "E3", "user <*> in")]
    paths = {}
    for name, rows in (("a", a), ("b", b)):
        paths[name] = str(tmp_path / name)
        io.write_structured(spark.createDataFrame(rows, cols), paths[name], "csv")
    lines, templates, rest = jobs.correct_systems(spark, paths, str(tmp_path / "out"))
    got = {(r["dataset"], r["LineId"]): (r["EventId"], r["EventTemplate"])
           for r in io.read_structured(spark, lines, "csv").collect()}
    assert got == {("a", "1"): ("E10", "user <*> in"), ("a", "2"): ("E10", "user <*> in"), ("a", "3"): (None, ""),
                   ("b", "1"): ("E3", "user <*> in")}
    assert {(r["dataset"], r["EventId"]) for r in io.read_structured(spark, templates, "csv").collect()} == {("a", "E10"), ("b", "E3")}
    assert [r["LineId"] for r in spark.read.option("header", True).csv(rest).collect()] == ["3"]
    parsed = spark.createDataFrame([(1, "user <*> in"), (2, "user <*> in")], "LineId long, EventTemplate string")
    io.write_structured(parsed, str(tmp_path / "parsed"))
    shares = jobs.classify_files(spark, lines + "/dataset=a", str(tmp_path / "parsed"), str(tmp_path / "classes"), "a").first()
    assert shares["PTA"] == 1.0 and shares["OG"] == 0.0
    assert [r["type"] for r in spark.read.parquet(str(tmp_path / "classes")).collect()] == ["SM"]
