"""State of the stream as snapshots and changes, and answers that outlive a failed task."""
import json
import os

import pytest
from pyspark.sql import functions as F

from logloom.streaming import online


def _state(spark, folder, before=10**9):
    templates, numbers = online.load_state(spark, folder, before)
    return sorted(r.template for r in templates.collect()), sorted((r.number, r.EventTemplate) for r in numbers.collect())


def test_changes_and_snapshots(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(online, "COMPACT_EVERY", 2)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    batches = [["job 1 on", "disk full"], ["job 2 off", "disk full"], ["net up"], ["job 3 off", "cpu hot 5"]]
    seen = []
    for b, lines in enumerate(batches):
        batch = spark.createDataFrame([(10 * b + i, c) for i, c in enumerate(lines)], "LineId long, Content string")
        online.parse_batch(batch, b, out, state)
        seen.append(_state(spark, state))
    names = ["job <*> on", "disk full", "job <*> off", "net up", "cpu hot <*>"]
    assert seen[-1] == (sorted(names), list(enumerate(names, 1)))
    assert [len(s[1]) for s in seen] == [2, 3, 4, 5]
    assert sorted(n for n in os.listdir(state) if n.startswith("snapshot")) == ["snapshot_id=1", "snapshot_id=3"]
    # a batch writes its changes only, whatever came before
    change = spark.read.parquet(state + "/batch_id=3")
    assert sorted((r.op, r.template) for r in change.collect()) == [("add", "cpu hot <*>"), ("id", "cpu hot <*>")]
    rows = {r.LineId: (r.EventId, r.EventTemplate) for r in online.read_output(spark, out).collect()}
    assert rows[10] == ("E3", "job <*> off") == rows[30] and rows[1] == ("E2", "disk full") == rows[11]
    # batch 3 again, as after a failure: the same files, from the state before it
    batch = spark.createDataFrame([(30 + i, c) for i, c in enumerate(batches[3])], "LineId long, Content string")
    online.parse_batch(batch, 3, out, state)
    assert _state(spark, state) == seen[-1] and _state(spark, state, 2) == seen[1]
    assert {r.LineId: (r.EventId, r.EventTemplate) for r in online.read_output(spark, out).collect()} == rows


def _asker(log, fail_at=None, silent=()):
    """A proposer that notes every prompt, fails once at the given call, and gives no answer the first time to some."""
    def ask(asked):
        calls = len(os.listdir(log))
        if calls == fail_at:
            open(f"{log}/failed", "w").close()
            raise RuntimeError("the model is gone")
        with open(f"{log}/{calls}-{os.getpid()}", "w") as f:
            json.dump(list(asked["content"]), f)
        import pandas as pd
        told = [c for n in os.listdir(log) if n != "failed" for c in json.load(open(f"{log}/{n}"))]
        return pd.Series([None if c in silent and told.count(c) < 2 else f"Log template: `{c.split()[0]} {{x}} {c.split()[2]}`" for c in asked["content"]])
    return ask


def _told(log):
    return sorted(c for n in os.listdir(log) if n != "failed" for c in json.load(open(f"{log}/{n}")))


def _asked(spark, n):
    rows = [(f"p{i}", f"word{i} a{i} end", json.dumps([{"role": "user", "content": "q"}])) for i in range(n)]
    return spark.createDataFrame(rows + rows[:3], "prompt string, rep_content string, messages string").coalesce(1)


def test_answers_outlive_a_failed_task(spark, tmp_path, monkeypatch):
    from logloom.operators import discovery
    monkeypatch.setattr(discovery, "ASKED_AT_ONCE", 4)
    log, folder = str(tmp_path / "log"), str(tmp_path / "answers")
    os.mkdir(log)
    with pytest.raises(Exception):  # the task dies at its third call: 8 answers are stored
        discovery.answers(_asked(spark, 20), _asker(log, fail_at=2), folder)
    assert len(_told(log)) == 8
    got = discovery.answers(_asked(spark, 20), _asker(log), folder).collect()
    assert sorted(r.prompt for r in got) == sorted(f"p{i}" for i in range(20))
    assert _told(log) == sorted(f"word{i} a{i} end" for i in range(20))  # none asked twice


def test_failed_answers_are_asked_again(spark, tmp_path):
    from logloom.operators.discovery import answers
    log = str(tmp_path / "log")
    os.mkdir(log)
    got = answers(_asked(spark, 6), _asker(log, silent=("word2 a2 end",)), str(tmp_path / "answers")).collect()
    assert len(got) == 6 and all(r.response for r in got)
    assert _told(log).count("word2 a2 end") == 2 and len(_told(log)) == 7


def test_stored_tables_align_without_a_shuffle(spark, tmp_path):
    from logloom.operators.metrics import align
    from logloom.sources.io import save_by_line
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [("s", i, None if i % 5 == 0 else f"t{i % 3}") for i in range(50)]
        truth = save_by_line(spark.createDataFrame(rows, "dataset string, LineId long, EventTemplate string"), str(tmp_path / "a"))
        parsed = save_by_line(spark.createDataFrame([r for r in rows if r[1] % 7], "dataset string, LineId long, EventTemplate string"), str(tmp_path / "b"))
        out = align(truth, parsed)
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        assert {(r.LineId, r.gt, r.parsed) for r in out.collect()} == {(i, t, (t or "") if i % 7 else "") for _, i, t in rows}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_split_offsets(spark):
    from logloom.sources.formats import split_offsets
    rows = [(f"f{i:05d}", b, (i * 7 + b) % 5) for i in range(3000) for b in (0, 128)]
    out = split_offsets(spark.createDataFrame(rows, "_file string, _block long, _n long").repartition(9), ["_file", "_block"])
    got, at = {(r._file, r._block): r._off for r in out.collect()}, 0
    assert "collect" not in split_offsets.__code__.co_names
    for f, b, n in sorted(rows):
        assert got[f, b] == at
        at += n
