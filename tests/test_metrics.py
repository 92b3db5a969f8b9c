"""Scores on hand-sized tables, checked against direct Python definitions."""
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from logloom.operators import metrics

ROWS = [  # LineId, gt, parsed
    (1, "A <*>", "A <*>"), (2, "A <*>", "A <*>"), (3, "B x", "B <*>"), (4, "B y", "B <*>"),
    (5, "C", "C"), (6, None, "C"), (7, "D <*>", "D 1"), (8, "D <*>", "D 2"), (9, "E", None),
]


def brute(rows):
    rows_nn = [(i, g, p if p is not None else "") for i, g, p in rows if g is not None]
    gt_n = Counter(g for _, g, _ in rows_nn)
    p_n = Counter(p for _, _, p in rows_nn)
    by_gt = defaultdict(set)
    for _, g, p in rows_nn:
        by_gt[g].add(p)
    correct = [g for g, ps in by_gt.items() if len(ps) == 1 and gt_n[g] == p_n[next(iter(ps))]]
    ga = sum(gt_n[g] for g in correct) / len(rows_nn)
    pga, rga = len(correct) / len(p_n), len(correct) / len(gt_n)
    fga = 2 * pga * rga / (pga + rga) if pga + rga else 0.0
    pa = sum(1 for _, g, p in rows if g is not None and g == (p or "")) / len(rows)
    by_p = defaultdict(set)
    for _, g, p in rows_nn:
        by_p[p].add(g)
    ok = sum(1 for p, gs in by_p.items() if gs == {p})
    pta, rta = ok / len(by_p), ok / len(gt_n)
    return dict(GA=ga, FGA=fga, PA=pa, PTA=pta, RTA=rta, FTA=2 * pta * rta / (pta + rta) if pta + rta else 0.0,
                tool_templates=len(by_p), ground_templates=len(gt_n))


@pytest.fixture
def pairs(spark):
    df = spark.createDataFrame([("d", i, g, p) for i, g, p in ROWS], "dataset string, LineId long, gt string, parsed string")
    aligned = metrics.align(df.select("dataset", "LineId", F.col("gt").alias("EventTemplate")),
                            df.filter(F.col("parsed").isNotNull()).select("dataset", "LineId", F.col("parsed").alias("EventTemplate")))
    return metrics.pair_counts(aligned)


def test_evaluate_matches_brute_force(pairs):
    row = metrics.evaluate(pairs).first().asDict()
    exp = brute(ROWS)
    for k, v in exp.items():
        assert row[k] == pytest.approx(v), k


def test_perfect_parse_scores_one(spark):
    df = spark.createDataFrame([("d", i, g) for i, g, _ in ROWS if g], "dataset string, LineId long, t string")
    al = metrics.align(df.withColumnRenamed("t", "EventTemplate"), df.withColumnRenamed("t", "EventTemplate"))
    row = metrics.evaluate(metrics.pair_counts(al)).first()
    assert row["GA"] == 1.0 and row["PA"] == 1.0 and row["FTA"] == 1.0


def test_merging_truth_groups_lowers_ga(spark):
    truth = [("d", i, "A" if i < 5 else "B") for i in range(10)]
    parsed = [("d", i, "X") for i in range(10)]
    t = spark.createDataFrame(truth, "dataset string, LineId long, EventTemplate string")
    p = spark.createDataFrame(parsed, "dataset string, LineId long, EventTemplate string")
    assert metrics.evaluate(metrics.pair_counts(metrics.align(t, p))).first()["GA"] == 0.0


def test_bands(spark, pairs):
    tt = spark.createDataFrame([("d", "A <*>", 2), ("d", "B x", 1), ("d", "B y", 1), ("d", "C", 1),
                                ("d", "D <*>", 2), ("d", "E", 1)], "dataset string, EventTemplate string, Occurrences long")
    band0 = metrics.complexity_band(tt, 1)
    assert sorted(r[0] for r in band0.select("EventTemplate").collect()) == ["B x", "B y", "C", "E"]
    assert metrics.complexity_band(tt, 3).count() == 0
    row = metrics.evaluate(pairs, metrics.complexity_band(tt, 3)).first()
    assert row["GA"] is None and row["PTA"] is None
    low = metrics.frequency_band(tt, 50, ["dataset"])
    assert sorted(r[0] for r in low.select("EventTemplate").collect()) == ["B x", "B y", "C"]
    high = metrics.frequency_band(tt, -34, ["dataset"])
    assert sorted(r[0] for r in high.select("EventTemplate").collect()) == ["A <*>", "D <*>"]


def test_compat_wildcard_count(spark):
    df = spark.createDataFrame([("a <*> -> b",)], "t string")
    r = df.select(metrics.wildcard_count(F.col("t")), metrics.wildcard_count(F.col("t"), True)).first()
    assert (r[0], r[1]) == (1, 2)


def test_template_classes(spark):
    rows = [("d", 1, "user <*>", "user <*>"), ("d", 2, "open abc", "open <*>"), ("d", 3, "close <*>", "close now"),
            ("d", 4, "x y", "q"), ("d", 5, "x z", "q"), ("d", 6, "wide <*>", "wide a b")]
    df = spark.createDataFrame(rows, "dataset string, LineId long, gt string, parsed string")
    p = metrics.pair_counts(metrics.align(df.select("dataset", "LineId", F.col("gt").alias("EventTemplate")),
                                          df.select("dataset", "LineId", F.col("parsed").alias("EventTemplate"))))
    got = {r["identified_template"]: r["type"] for r in metrics.template_classes(p).collect()}
    # <*> becomes (\S+?): it never spans a space, so "wide a b" is not under "wide <*>"
    assert got == {"user <*>": "SM", "open <*>": "OG", "close now": "UG", "q": "MX", "wide a b": "MX"}


def test_summary_average_and_transpose(spark):
    s = spark.createDataFrame([("a", 1, 0.5, 1.0), ("b", 1, 1.0, 0.0), ("a", 2, 0.0, 0.0)],
                              "dataset string, load_order int, GA double, PA double")
    out = {r["dataset"]: (r["GA"], r["PA"]) for r in metrics.summary_with_average(s).collect()}
    assert out == {"a": (0.5, 1.0), "b": (1.0, 0.0), "Average": (0.75, 0.5)}
    t = {r["metric"]: r["Average"] for r in metrics.transpose(metrics.summary_with_average(s)).collect()}
    assert t == {"GA": 0.75, "PA": 0.5}
