"""Oracle correction: the merge example, string-order ids, natural sort."""
from logloom.operators.correction import correct, correction_counts


def test_send_example(spark):
    df = spark.createDataFrame([(1, "E1", "Send 123", "Send 123"), (2, "E2", "Send 456", "Send 456")],
                               "LineId long, EventId string, Content string, EventTemplate string")
    lines, templates, report = correct(df)
    assert sorted(tuple(r) for r in lines.select("LineId", "EventId", "EventTemplate").collect()) == \
        [(1, "E1", "Send <*>"), (2, "E1", "Send <*>")]
    assert [tuple(r) for r in templates.select("EventId", "EventTemplate").collect()] == [("E1", "Send <*>")]
    assert report.count() == 0


def test_string_order_and_natural_sort(spark):
    rows = [(1, "E2", "x", "open 1"), (2, "E10", "y", "open 2"), (3, "E3", "z", "close true"),
            (4, "E4", "w", "path /a/b.c here")]
    df = spark.createDataFrame(rows, "LineId long, EventId string, Content string, EventTemplate string")
    lines, templates, _ = correct(df)
    got = {r["LineId"]: (r["EventId"], r["EventTemplate"]) for r in lines.collect()}
    assert got[1] == ("E10", "open <*>") and got[2] == ("E10", "open <*>")
    assert got[3] == ("E3", "close <*>") and got[4] == ("E4", "path <*> here")
    assert [r["EventId"] for r in templates.orderBy("pos").collect()] == ["E3", "E4", "E10"]
    c = correction_counts(df).first()
    assert (c["n_original"], c["n_corrected"], c["n_changed"]) == (4, 3, 4)
