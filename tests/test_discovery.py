"""Batch parse, partition independence, proposer plug-in, streaming = batch."""
from pyspark.sql import functions as F

from logloom.operators.discovery import discover, parse
from logloom.sources.fixtures import rendered_events


def _result(structured):
    return sorted((r["LineId"], r["EventId"], r["EventTemplate"]) for r in structured.collect())


def test_parse_gives_expected_templates(spark, sf):
    ev = rendered_events(spark, sf)
    s, _ = parse(ev.select("LineId", "Content"))
    j = s.join(ev.select("LineId", "expected"), "LineId")
    assert j.filter(F.col("EventTemplate") != F.col("expected")).count() == 0
    assert j.select("EventTemplate").distinct().count() == ev.select("expected").distinct().count()


def test_same_result_for_1_and_n_partitions(spark, sf):
    ev = rendered_events(spark, sf).select("LineId", "Content")
    a, _ = parse(ev.coalesce(1))
    b, _ = parse(ev.repartition(7))
    assert _result(a) == _result(b)


def test_known_templates_are_reused(spark, sf):
    ev = rendered_events(spark, sf).select("LineId", "Content")
    tpl = spark.createDataFrame([(100, "view page /p/<*> status <*>")], "template_id long, template string")
    st = []
    assigned, T = discover(ev, tpl, stats=st)
    got = {r["template"]: r["template_id"] for r in T.collect()}
    assert got["view page /p/<*> status <*>"] == 100


def test_proposer_plugin_and_self_check(spark):
    lines = spark.createDataFrame([(1, "user 12 logged in"), (2, "user 13 logged in"), (3, "disk sda full"),
                                   (4, "single")], "LineId long, Content string")

    def proposer(pdf):
        out = []
        for c in pdf["content"]:
            if c.startswith("disk"):
                out.append("Log template: `totally different`")   # fails the self-check
            else:
                out.append("Log template: `user {uid} logged in`")
        return out

    s, _ = parse(lines, proposer=proposer)
    got = {r["LineId"]: r["EventTemplate"] for r in s.collect()}
    assert got[1] == got[2] == "user <*> logged in"
    assert got[3] == "disk sda full"          # rule template (no digits) after the failed check
    assert got[4] == "single"                 # one-word message: no model call


def test_stream_equals_batch(spark, sf):
    import __spark_entry__ as E
    a = E.queries()["stream_parse"](spark, sf)
    b = E.queries()["event_ids"](spark, sf)
    assert _result(a) == _result(b)


def _lcs(x, y):
    t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            t[i + 1][j + 1] = t[i][j] + 1 if x[i] == y[j] else max(t[i + 1][j], t[i][j + 1])
    return t[-1][-1]


def test_merge_similar_equals_brute_force(spark, sf):
    from logloom.operators.discovery import merge_similar
    from logloom.sources.fixtures import rendered_events
    ev = rendered_events(spark, sf).filter(F.col("event_type") == "click")
    rows = sorted({r["Content"] for r in ev.select("Content").collect()})
    tpl = spark.createDataFrame(list(enumerate(rows)), "template_id long, template string")
    got = {r["template_id"]: (r["template"], list(r["merged_from"])) for r in merge_similar(tpl).collect()}
    words = {i: t.split(" ") for i, t in enumerate(rows)}
    best = {}
    for b in words:
        cands = [(2 * _lcs(words[a], words[b]) / (2 * len(words[b])), -a) for a in words
                 if a < b and len(words[a]) == len(words[b]) and words[a][0] == words[b][0]]
        cands = [c for c in cands if c[0] > 0.8]
        if cands:
            best[b] = -max(cands)[1]
    exp = {}
    for a in words:
        if a in best:
            continue
        ms = sorted(b for b, o in best.items() if o == a)
        w = list(words[a])
        for b in ms:
            w = [x if x == y else "<*>" for x, y in zip(w, words[b])]
        exp[a] = (" ".join(w), ms)
    assert got == exp


def test_stream_restart_resumes_without_repeats(spark, sf):
    """H2: stop after part of the input, add files, restart from the
    checkpoint: every line exactly once and the same templates as batch."""
    import tempfile
    from logloom.streaming import online
    ev = rendered_events(spark, sf).select("LineId", "Content")
    base = tempfile.mkdtemp(prefix="logloom-stream-")
    src, out, state, chk = base + "/src", base + "/out", base + "/state", base + "/chk"
    for lo in (0, 300):  # a stream reads files in the order they come
        ev.filter((F.col("LineId") > lo) & (F.col("LineId") <= lo + 300)).coalesce(1).write.mode("append").parquet(src + "/a")
    q = online.start(spark, src + "/a", out, state, chk)
    q.awaitTermination()
    n1 = spark.read.parquet(out).count()
    # new input arrives; the restarted query must only process the new file set
    ev.filter(F.col("LineId") > 600).coalesce(1).write.mode("append").parquet(src + "/a")
    q = online.start(spark, src + "/a", out, state, chk)
    q.awaitTermination()
    res = online.read_output(spark, out)
    assert n1 == ev.filter(F.col("LineId") <= 600).count() and res.count() == ev.count()
    assert res.select("LineId").distinct().count() == ev.count()
    batch, _ = parse(ev)
    assert _result(res.select("LineId", "EventId", "EventTemplate")) == _result(batch)


def test_large_template_table_path_same_result(spark, sf, monkeypatch):
    """With broadcasting ruled out by the size check, the parse takes the
    shuffled distinct-signature path and must give the same result."""
    from logloom.operators import matching
    ev = rendered_events(spark, sf).select("LineId", "Content")
    a, _ = parse(ev)
    expected = _result(a)
    monkeypatch.setattr(matching, "BROADCAST_BYTES", 0)
    b, _ = parse(ev)
    assert _result(b) == expected


def test_many_datasets_in_one_job(spark, sf):
    ev = rendered_events(spark, sf).select("LineId", "Content")
    ds = F.concat(F.lit("part"), ((F.col("LineId") - 1) % 2).cast("string"))
    both = ev.withColumn("dataset", ds)
    together, T = parse(both, group_col="dataset")
    got = sorted((r["dataset"], r["LineId"], r["EventId"], r["EventTemplate"]) for r in together.collect())
    exp = []
    for name in ("part0", "part1"):
        alone, _ = parse(both.filter(F.col("dataset") == name).drop("dataset"))
        exp += [(name, r["LineId"], r["EventId"], r["EventTemplate"]) for r in alone.collect()]
    assert got == sorted(exp)
    assert T.select("dataset").distinct().count() == 2


def test_stream_many_datasets(spark, sf):
    import tempfile
    from logloom.streaming import online
    ev = rendered_events(spark, sf).select("LineId", "Content")
    ev = ev.withColumn("dataset", F.concat(F.lit("part"), ((F.col("LineId") - 1) % 2).cast("string")))
    base = tempfile.mkdtemp(prefix="logloom-stream2-")
    for i in range(3):  # a stream reads files in the order they come
        ev.filter((F.col("LineId") > 400 * i) & (F.col("LineId") <= 400 * (i + 1))).coalesce(1).write.mode("append").parquet(base + "/src")
    q = online.start(spark, base + "/src", base + "/out", base + "/state", base + "/chk", group_col="dataset")
    q.awaitTermination()
    got = sorted((r["dataset"], r["LineId"], r["EventId"], r["EventTemplate"])
                 for r in online.read_output(spark, base + "/out", "dataset").collect())
    batch, _ = parse(ev, group_col="dataset")
    exp = sorted((r["dataset"], r["LineId"], r["EventId"], r["EventTemplate"]) for r in batch.collect())
    assert got == exp


def test_parse_has_one_meaning_at_any_table_size(spark, monkeypatch):
    """The map-side match, a broadcast limit of nothing and no literal templates give the same lines."""
    from logloom.operators import matching
    tpl = spark.createDataFrame([(1, "job <*> on"), (2, "<*> zzz")], "template_id long, template string")
    lines = spark.createDataFrame([(1, "job a state on"), (2, "job a state 7")], "LineId long, Content string")
    want = _result(parse(lines, tpl)[0])
    assert [t for _, _, t in want] == ["job a state <*>"] * 2
    monkeypatch.setattr(matching, "MAX_LITERAL_TEMPLATES", 0)
    assert _result(parse(lines, tpl)[0]) == want
    monkeypatch.setattr(matching, "BROADCAST_BYTES", 0)
    assert _result(parse(lines, tpl)[0]) == want


def test_many_leading_wildcard_templates(spark):
    from logloom.operators.matching import match_messages
    tpl = spark.createDataFrame([(i, f"<*> word{i}") for i in range(1000)], "template_id long, template string")
    lines = spark.createDataFrame([(i, f"some word{i}") for i in range(0, 1000, 50)], "LineId long, Content string")
    got = match_messages(lines, tpl).collect()
    assert all(r.template_id == r.LineId for r in got) and len(got) == 20


def test_new_template_ids_never_collide(spark):
    """Line numbers from 0, or as large as a log of 10^12 lines has, in several datasets."""
    tpl = spark.createDataFrame([(0, "a b", "x"), (10**15, "e f", "y")], "template_id long, template string, dataset string")
    rows = [(0, "c d", "x"), (1, "a b", "x"), (10**12, "g h", "y"), (10**12, "i j", "x"), (10**12 + 1, "k l", "y")]
    lines = spark.createDataFrame(rows, "LineId long, Content string, dataset string")
    for group in (None, "dataset"):
        _, T = parse(lines.drop("dataset") if group is None else lines, tpl.drop("dataset") if group is None else tpl, group_col=group)
        ids = [r.template_id for r in T.collect()]
        assert len(ids) == len(set(ids)) == 6 and min(i for i in ids if i not in (0, 10**15)) == 10**15 + 1


def test_ranked_has_no_gaps(spark):
    from logloom.session import ranked
    df = spark.range(1000).withColumn("k", F.xxhash64("id")).repartition(5)
    got = [r.n for r in ranked(df, ["k"], "n", 7).orderBy("k").collect()]
    assert got == list(range(7, 1007))
    assert ranked(df.limit(0), ["k"], "n").count() == 0


def test_damaged_old_state_does_not_empty_the_state(spark, tmp_path):
    import os
    from logloom.streaming.online import _latest_state
    root = str(tmp_path / "state")
    assert _latest_state(spark, root, 5).count() == 0
    for b in (0, 1):
        spark.createDataFrame([(b, f"t {b}")], "template_id long, template string").write.parquet(f"{root}/batch_id={b}")
    for name in os.listdir(f"{root}/batch_id=0"):
        if name.endswith(".parquet"):
            with open(f"{root}/batch_id=0/{name}", "wb") as f:
                f.write(b"damaged")
    assert [r.template for r in _latest_state(spark, root, 2).collect()] == ["t 1"]
    import pytest
    with pytest.raises(Exception):
        _latest_state(spark, root, 1).collect()


def test_merge_of_templates_that_share_their_words(spark, monkeypatch):
    """Few words in many combinations: every word is frequent, so no pairs may be made from shared words."""
    import random
    from logloom.operators import discovery
    rng = random.Random(3)
    rows = ["a " + " ".join(rng.choice("bcde") for _ in range(n)) for n in (0, 1, 2, 5, 5, 7, 9, 11) for _ in range(25)]
    long = ["a " + " ".join(rng.choice("bc") for _ in range(29)) for _ in range(3)]
    long += [t[:-1] + "z" for t in long]
    names, cut = [], discovery.cut_lineage
    monkeypatch.setattr(discovery, "cut_lineage", lambda df, name="cut": names.append(name) or cut(df, name))
    for some, by_prefix in ((rows, False), (rows + long, True)):
        words = {i: t.split(" ") for i, t in enumerate(some)}
        exp = {}
        for b in words:
            cands = [(_lcs(words[a], words[b]) / len(words[b]), -a) for a in words if a < b and len(words[a]) == len(words[b])]
            cands = [c for c in cands if c[0] > 0.8]
            if cands:
                exp.setdefault(-max(cands)[1], []).append(b)
        names.clear()
        got = {r["template_id"]: list(r["merged_from"]) for r in discovery.merge_similar(
            spark.createDataFrame(list(enumerate(some)), "template_id long, template string")).collect()}
        assert ("merge-prefixes" in names) == by_prefix
        gone = {b for ms in exp.values() for b in ms}
        assert got == {a: exp.get(a, []) for a in words if a not in gone}
