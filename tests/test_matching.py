"""Template matching: winner rule, leading wildcards, parameters, brute force."""
from pyspark.sql import functions as F

from logloom.functions import text as T
from logloom.operators import matching


def glob(tpl, msg):
    """Brute force: <*> takes zero or more whole tokens."""
    if not tpl:
        return not msg
    if tpl[0] == "<*>":
        return any(glob(tpl[1:], msg[i:]) for i in range(len(msg) + 1))
    return bool(msg) and msg[0] == tpl[0] and glob(tpl[1:], msg[1:])


TEMPLATES = [
    (1, "user <*> logged in"),
    (2, "user bob logged in"),
    (3, "<*> logged in"),
    (4, "user <*> logged <*>"),
    (5, "disk <*> full"),
    (6, "<*> session <*>"),
    (7, "a <*> b"),
]
MESSAGES = ["user bob logged in", "user alice logged in", "root logged in", "user x logged out now",
            "disk full", "disk sda1 full", "new session opened", "a x y b", "a b", "nothing here"]


def brute_best(msg):
    mt = T_tokens(msg)
    best = None
    for tid, t in TEMPLATES:
        tt = T_tokens(t)
        if glob(tt, mt):
            key = (-sum(x != "<*>" for x in tt), sum(x == "<*>" for x in tt), [x == "<*>" for x in tt], tid)
            if best is None or key < best[0]:
                best = (key, tid)
    return None if best is None else best[1]


def T_tokens(s):
    from tests.test_text import brute_tokens
    return brute_tokens(s)


def test_best_match_equals_brute_force(spark):
    msgs = spark.createDataFrame([(i, m) for i, m in enumerate(MESSAGES)], "LineId long, Content string")
    tpl = spark.createDataFrame(TEMPLATES, "template_id long, template string")
    got = {r["LineId"]: r["template_id"] for r in matching.match_messages(msgs, tpl).collect()}
    assert got == {i: brute_best(m) for i, m in enumerate(MESSAGES)}


def test_params(spark):
    msgs = spark.createDataFrame([(1, "a x y b"), (2, "a b")], "LineId long, Content string")
    tpl = spark.createDataFrame([(7, "a <*> b")], "template_id long, template string")
    got = {r["LineId"]: list(r["params"]) for r in matching.match_messages(msgs, tpl, with_params=True).collect()}
    assert got == {1: ["xy"], 2: [""]}


def test_no_broadcast_plan_same_result(spark):
    msgs = spark.createDataFrame([(i, m) for i, m in enumerate(MESSAGES)], "LineId long, Content string")
    tpl = spark.createDataFrame(TEMPLATES, "template_id long, template string")
    sigs = msgs.select(T.signature("Content").alias("sig")).distinct()
    a = {r["sig"]: r["template_id"] for r in matching.best_match(sigs, tpl, broadcast=True).collect()}
    b = {r["sig"]: r["template_id"] for r in matching.best_match(sigs, tpl, broadcast=False).collect()}
    assert a == b


def test_plan_is_blocked_broadcast_join(spark):
    msgs = spark.createDataFrame([(i, m) for i, m in enumerate(MESSAGES)], "LineId long, Content string")
    tpl = spark.createDataFrame(TEMPLATES, "template_id long, template string")
    plan = matching.match_messages(msgs, tpl)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_own_template_matches_own_message(spark, sf):
    from logloom.sources.fixtures import rendered_events
    ev = rendered_events(spark, sf)
    df = ev.select(T.signature("Content").alias("sig"), T.propose_template(F.col("Content")).alias("t"))
    df = df.withColumn("pat", T.match_pattern(T.tokens(F.col("t"))))
    assert df.filter(~F.rlike(F.col("sig"), F.col("pat"))).count() == 0


def test_event_ids_first_appearance(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, None)], "LineId long, EventTemplate string")
    got = {r["LineId"]: r["EventId"] for r in matching.assign_event_ids(df).collect()}
    assert got == {1: "E1", 2: "E2", 3: "E1", 4: None}


def test_relevant_templates_brute_force(spark):
    msgs = ["user bob logged out", "disk sda1 empty", "nothing here", "user", "a x"]
    df = spark.createDataFrame([(m,) for m in msgs], "Content string").select(T.signature("Content").alias("sig"))
    tpl = spark.createDataFrame(TEMPLATES, "template_id long, template string")
    got = {tuple(r["sig"].split("\x1f")[:-1]): (r["depth"], sorted(r["relevant"]))
           for r in matching.relevant_templates(df, tpl).collect()}
    exp = {}
    for m in msgs:
        mt = T_tokens(m)
        best, rel = 0, []
        for _, t in TEMPLATES:
            tt = T_tokens(t)
            k = 0
            while k < min(len(mt), len(tt)) and mt[k] == tt[k]:
                k += 1
            if k > best:
                best, rel = k, [t]
            elif k == best and k > 0:
                rel.append(t)
        if best > 0:
            exp[tuple(mt)] = (best, sorted(rel))
    assert got == exp


def test_parse_plan_does_not_shuffle_lines(spark, sf):
    from logloom.operators.discovery import parse
    from logloom.sources.fixtures import rendered_events
    s, _ = parse(rendered_events(spark, sf).select("LineId", "Content"))
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan
    assert plan.count("BroadcastHashJoin") >= 3


def test_distinct_mode_params_equal_map_mode(spark):
    msgs = spark.createDataFrame([(i, m) for i, m in enumerate(MESSAGES)], "LineId long, Content string")
    tpl = spark.createDataFrame(TEMPLATES, "template_id long, template string")
    a = {r["LineId"]: (r["template_id"], None if r["params"] is None else list(r["params"]))
         for r in matching.match_messages(msgs, tpl, with_params=True, mode="map").collect()}
    b = {r["LineId"]: (r["template_id"], None if r["params"] is None else list(r["params"]))
         for r in matching.match_messages(msgs, tpl, with_params=True, mode="distinct").collect()}
    assert a == b


def test_large_template_tables_are_prepared_once(spark):
    """The join over distinct signatures reads the prepared templates several times; their texts are read once."""
    read = spark.sparkContext.accumulator(0)

    def counted(it):
        for pdf in it:
            read.add(len(pdf))
            yield pdf

    msgs = spark.createDataFrame([(i, m) for i, m in enumerate(MESSAGES)], "LineId long, Content string")
    tpl = spark.createDataFrame(TEMPLATES, "template_id long, template string").mapInPandas(counted, "template_id long, template string")
    got = {r["LineId"]: r["template_id"] for r in matching.match_messages(msgs, tpl, mode="distinct").collect()}
    assert got == {i: brute_best(m) for i, m in enumerate(MESSAGES)}
    assert read.value == len(TEMPLATES)


def test_parts_decide_as_the_pattern_does(spark):
    """Every signature of a few tokens against every template of a few: the text around the wildcards and the regex agree."""
    import itertools
    texts = [" ".join(w) for n in range(1, 6) for w in itertools.product(["a", "aa", "<*>"], repeat=n)] + ["a \x1f a", "a\x1fa", "<*> \x1f a", "a \x1f <*>"]
    tp = matching.prepare_templates(spark.createDataFrame(list(enumerate(texts)), "template_id long, template string"))
    words = ["a", "aa", "b"]
    odd = [(f"a{sep}a", ) for sep in (" \x1f ", "\x1f", " \x1f\x1f")]
    msgs = spark.createDataFrame([(" ".join(w),) for n in range(6) for w in itertools.product(words, repeat=n)] + odd, "m string")
    both = msgs.select(T.signature("m").alias("sig")).distinct().crossJoin(F.broadcast(tp.dropDuplicates(["t_sig"])))
    row = both.select(matching._fits().alias("f"), F.rlike("sig", "pattern").alias("r")).agg(
        F.count_if(F.col("f") != F.col("r")).alias("wrong"), F.count_if("f").alias("fit"), F.count("f").alias("n"), F.count("*").alias("all")).first()
    assert row.wrong == 0 and row.fit > 1000 and row.n == row["all"]


def test_signature_equals_its_regexes(spark):
    """Signatures of texts with and without wildcards, empty ones, separators inside and runs of wildcards."""
    texts = ["", None, " ", "a", "a b=c(d)", "<*>", "<*> <*> x<*>y z", "a\x1fb \x1f", "\x1f", "= <*>=<*>", "<*", "!<*>!", "café  x", "x\n<*>\n<*> y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    marked = F.regexp_replace("t", T.TOKEN_CHAR + r"*<\*>" + T.TOKEN_CHAR + r"*", T.WILDCARD)
    joined = F.concat(F.array_join(F.regexp_extract_all(marked, F.lit(T.TOKEN), 0), T.SEP), F.lit(T.SEP))
    old = F.regexp_replace(F.regexp_replace(joined, "^" + T.SEP + "$", ""), "(?:<\\*>" + T.SEP + "){2,}", T.WILDCARD + T.SEP)
    for r in df.select("t", T.signature("t").alias("new"), old.alias("old")).collect():
        assert r.new == r.old, r.t
