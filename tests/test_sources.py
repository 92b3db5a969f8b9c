"""Formats, line ids, IO helpers, small operators without a registered query."""
import os
import tempfile

from pyspark.sql import functions as F

from logloom.sources import formats, io

LINES = {
    "Thunderbird": ("- 1131566461 2005.11.09 dn228 Nov 9 12:01:01 dn228/dn228 crond(pam_unix)[2915]: session closed",
                    {"Component": "crond(pam_unix)", "PID": "2915", "Content": "session closed"}),
    "Linux": ("Jun 14 15:16:01 combo sshd(pam_unix)[19939]: authentication failure; logname=",
              {"Component": "sshd(pam_unix)", "PID": "19939", "Content": "authentication failure; logname="}),
    "Mac": ("Jul  1 09:00:55 calvisitor-10-105-160-95 kernel[0]: IOThunderboltSwitch<0>(0x0)::listenerCallback - x",
            {"Component": "kernel", "PID": "0", "Content": "IOThunderboltSwitch<0>(0x0)::listenerCallback - x"}),
    "HealthApp": ("20171223-22:15:29:606|Step_LSC|30002312|onStandStepChanged 3579",
                  {"Component": "Step_LSC", "Pid": "30002312", "Content": "onStandStepChanged 3579"}),
    "Zookeeper": ("2015-07-29 17:41:44,747 - INFO  [QuorumPeer[myid=1]/0:0:0:0:0:0:0:0:2181:FastLeaderElection@774] - Notification time out: 3200",
                  {"Level": "INFO", "Id": "774", "Content": "Notification time out: 3200"}),
}


def test_format_groups_with_optional_parts(spark):
    for name, (line, exp) in LINES.items():
        df = spark.createDataFrame([(line,)], "value string")
        row = formats.split_headers(df, formats.lookup_format(name)).first()
        assert row is not None, name
        for k, v in exp.items():
            assert row[k] == v, (name, k, row[k])


def test_consecutive_ids_follow_file_order(spark):
    d = tempfile.mkdtemp(prefix="logloom-raw-")
    for i, chunk in enumerate([["a 1", "bad", "b 2"], ["c 3"], ["bad", "d 4", "e 5"]]):
        with open(os.path.join(d, f"part-{i:03d}.log"), "w") as f:
            f.write("\n".join(chunk) + "\n")
    got = formats.read_raw_logs(spark, d, "<W> <N>").orderBy("LineId").select("LineId", "W").collect()
    assert [(r[0], r[1]) for r in got] == [(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e")]


def test_load_report(spark):
    df = spark.createDataFrame([("x: y",), ("nope",), ("a: b",), ("",)], "value string")
    r = formats.load_report(df, "<A>: <B>").first()
    assert (r["n_lines"], r["n_matched"], r["loading_rate"]) == (4, 2, 0.5)


def test_formalize(spark):
    df = spark.createDataFrame([(1, "héllo wörld"), (2, "   "), (3, "plain")], "src long, value string")
    got = {r["src"]: r["Content"] for r in formats.formalize_messages(df, "<Content>").collect()}
    assert got == {1: "h<N/ASCII>llo w<N/ASCII>rld", 3: "plain"}


def test_io_roundtrip_and_examples(spark):
    d = tempfile.mkdtemp(prefix="logloom-io-")
    df = spark.createDataFrame([(1, "E1", 'say "hi", ok', None)], "LineId long, EventId string, Content string, EventTemplate string")
    io.write_structured(df, d + "/s", "csv")
    back = io.read_structured(spark, d + "/s", "csv").first()
    assert back["Content"] == 'say "hi", ok' and back["EventTemplate"] == ""
    ex = spark.createDataFrame([("q 1", "q <*>")], "query string, answer string")
    io.write_examples(ex, d + "/e")
    assert io.read_examples(spark, d + "/e").first()["answer"] == "q {variables}"
    io.append_summary(spark.createDataFrame([("a", 1.0)], "dataset string, GA double"), d + "/sum")
    io.append_summary(spark.createDataFrame([("b", 0.5)], "dataset string, GA double"), d + "/sum")
    assert spark.read.parquet(d + "/sum").count() == 2


def test_corresponding_truth_and_prompts(spark):
    from logloom.operators import metrics
    from logloom.operators.discovery import build_completion_prompt, build_prompt
    al = spark.createDataFrame([("d", 1, "A"), ("d", 2, "B"), ("d", 3, "A")], "dataset string, LineId long, gt string")
    ids = spark.createDataFrame([("d", 1), ("d", 3)], "dataset string, LineId long")
    assert metrics.corresponding_truth(al, ids).first()["truth_templates"] == ["A"]
    q = spark.createDataFrame([("m 1",)], "q string")
    r = q.select(build_prompt(F.col("q")).alias("p"), build_completion_prompt(F.col("q")).alias("c")).first()
    assert [m["role"] for m in r["p"]] == ["system", "user", "assistant", "user", "assistant", "user"]
    assert r["p"][-1]["content"] == "Log message: `m 1`"
    assert r["c"].endswith("Please parse the following log message:\nLog message: `m 1`\n")


def test_first_share_and_mean_by_shot(spark):
    from logloom.operators import sampling
    df = spark.createDataFrame([(i,) for i in range(1, 11)], "row_id long")
    assert sampling.first_share(df, 0.2).count() == 2
    st = spark.createDataFrame([("a", 8, 1.0), ("b", 8, 0.5)], "dataset string, shot int, coverage double")
    assert sampling.mean_by_shot(st).first()["coverage"] == 0.75


def test_many_files_of_ten_lines_written_by_few_tasks(spark, tmp_path, monkeypatch):
    """A file for every ten lines needs no task for every file; folders and files keep the lines' order."""
    import glob
    from logloom import session
    from logloom.plans import varied
    monkeypatch.setattr(varied, "FOLDER_LINES", 400)
    monkeypatch.setattr(session, "scratch_path", lambda spark, name: str(tmp_path / name))
    n = 2345
    spark.range(n).selectExpr("(id * 7919) % 2345 AS event_id", "id AS user_id", "'{\"k\": 3}' AS props").write.parquet(str(tmp_path / "events.parquet"))
    got = varied.read_many_files(spark, str(tmp_path)).collect()
    exp = {r.LineId: r.Content for r in varied.varied_events(spark, str(tmp_path)).collect()}
    assert len(got) == n and {r.LineId: r.Content for r in got} == exp
    files = glob.glob(str(tmp_path / "manyfiles" / "**" / "*.txt"), recursive=True)
    sizes = [sum(1 for _ in open(f)) for f in files]
    assert sum(sizes) == n and max(sizes) == 10 and len(files) <= n // 10 + 6
    assert len({f.rsplit("/", 2)[1] for f in files}) == 6


def test_lines_are_split_once(spark):
    """The format's regex stands once in the plan; lines that end oddly are stripped as the regexes strip them."""
    texts = ["  [t] [x] hello  ", "[t] [x]", "", " ", None, "[t] [x] a \u0085", "[t] [x] a  \u2028", "\u0085", "[t] [x] \u00e9\x1c ", "no fit",
             "\t\x0b\f\r[t] [x] b\r", "[t] [x] a\x00\x1fb"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, value string")
    for fmt in (formats.lookup_format("Apache"), "<Content>"):
        got = formats.split_headers(df, fmt)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("lazy") == 0 and plan.count("trim") <= 1
        headers, regex, groups = formats.compile_format(fmt)
        part = formats._PART
        taken = F.regexp_replace(F.regexp_replace("value", r"^\s+|\s+$", ""), regex, part + part.join(f"${g}" for g in groups))
        exp = {}
        for r in df.select("i", F.split(taken, part).alias("p")).collect():
            if r.p is not None and r.p[0] == "" and len(r.p) == len(headers) + 1:
                exp[r.i] = tuple(r.p[1:])
        assert {r.i: tuple(r[h] for h in headers) for r in got.collect()} == exp
        every = {r.i: (r.matched, tuple(r[h] for h in headers)) for r in formats.split_headers(df, fmt, keep_unmatched=True).collect()}
        assert every == {i: (i in exp, exp.get(i, ("",) * len(headers))) for i in range(len(texts))}


def test_many_files_need_few_tasks(spark, tmp_path, monkeypatch):
    """However little Spark puts into a task of its file sources, hundreds of small files are read by few tasks."""
    from logloom import session
    from logloom.plans import varied
    monkeypatch.setattr(session, "scratch_path", lambda spark, name: str(tmp_path / name))
    spark.range(2000).selectExpr("id AS event_id", "id AS user_id", "'{\"k\": 3}' AS props").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    sc, conf, most = spark.sparkContext, "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(conf, "4m")  # the cost of opening a file
    sc.setJobGroup("many-files", "")
    try:
        assert varied.read_many_files(spark, str(tmp_path)).count() == 2000
    finally:
        spark.conf.set(conf, most)
        sc.setLocalProperty("spark.jobGroup.id", None)
    seen = sc.statusTracker()
    stages = [seen.getStageInfo(i) for job in seen.getJobIdsForGroup("many-files") for i in seen.getJobInfo(job).stageIds]
    assert 0 < max(x.numTasks for x in stages if x) <= 50


def test_small_files_hold_the_lines_of_the_text_source(spark, tmp_path, monkeypatch):
    """Line ends, marks, hidden and packed files, folders between files, lists of two files and blocks of five bytes."""
    import gzip
    import os
    texts = {"b.txt": b"one\ntwo\r\nthree\rfour", "b/x.txt": b"\n\n \n", "b-c/y.txt": b"\xef\xbb\xbfmark\n\xef\xbb\xbfno mark\n", "c.txt": b"", "a b/z%20.txt": b"sp\n",
             "c1.txt": b"caf\xc3\xa9 \xff bytes\r\r\n", "c2.txt": b"a\x00b\x1fc\xe2\x80\xa8d\x0ce\n", "c3.txt": b"long " * 20 + b"\r" + b"x" * 30 + b"\nend\r",
             "d/e/f/deep.txt": b"deep\n", ".hidden": b"no\n", "_SUCCESS": b"no\n", "d/_tmp/n.txt": b"no\n", "k=1/.crc": b"no\n", "_k=1/p.txt": b"yes\n", "g.txt.gz": gzip.compress(b"packed\nlines\n")}
    root = tmp_path / "logs"
    for name, data in texts.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    hidden = {".hidden", "_SUCCESS", "d/_tmp/n.txt", "k=1/.crc"}
    packed = {"g.txt.gz": b"packed\nlines\n"}
    exp = [line for name in sorted(set(texts) - hidden, key=lambda n: os.path.join(str(root), n).encode())
           for line in packed.get(name, texts[name]).removeprefix(b"\xef\xbb\xbf").splitlines()]
    paths = [str(root / n) for n in os.listdir(root) if n not in hidden]
    text = sorted(bytes(r.b) for p in paths for r in spark.read.option("recursiveFileLookup", True).text(p.replace("%", "%25")).selectExpr("cast(value AS binary) AS b").collect())
    for run, size, lines in ((500, 4 << 20, 10_000), (2, 5, 3)):
        monkeypatch.setattr(formats, "RUN_FILES", run)
        monkeypatch.setattr(formats, "READ_BYTES", size)
        monkeypatch.setattr(formats, "READ_LINES", lines)
        got = formats.consecutive_ids(formats.small_file_lines(spark, str(root)), order_cols=["_run"])
        rows = got.selectExpr("LineId", "cast(value AS binary) AS b").orderBy("LineId").collect()
        assert [r.LineId for r in rows] == list(range(1, len(exp) + 1))
        assert [bytes(r.b) for r in rows] == exp and sorted(exp) == text
    ids = formats.read_raw_logs(spark, [str(root / "b.txt"), str(root / "b")], "<W>", small_files=True)
    assert [(r.LineId, r.W) for r in ids.orderBy("LineId").collect()] == [(1, "one"), (2, "two"), (3, "three"), (4, "four"), (5, ""), (6, ""), (7, "")]
