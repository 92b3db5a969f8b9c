"""Sequential parse against a line-by-line reading, and the inverted index against brute force."""
import random
import re

import pytest
from pyspark.sql import functions as F

from logloom.functions import text as T
from logloom.operators import matching
from tests.test_text import brute_tokens


def pattern(tokens):
    return re.compile("^" + "".join("(?:[^\x1f]*\x1f)*" if t == "<*>" else re.escape(t) + "\x1f" for t in tokens) + "$")


def signature(text):
    return "".join(t + "\x1f" for t in brute_tokens(text))


def line_by_line(rows, known=()):
    """rows: (line, content, rule).  {line: template}."""
    born, out = [], {}

    def add(text, line):
        t = brute_tokens(text)
        if t and t != ["<*>"] and all(t != o for _, o, _, _ in born):
            born.append(((-sum(x != "<*>" for x in t), sum(x == "<*>" for x in t), [x == "<*>" for x in t], line), t, pattern(t), text))
    for text in known:
        add(text, -1)
    for line, content, rule in sorted(rows):
        fits = [(k, text) for k, _, p, text in born if p.match(signature(content))]
        out[line] = min(fits)[1] if fits else rule
        if not fits and rule is not None:
            add(rule, line)
    return out


def some_lines(seed, n=200):
    rng = random.Random(seed)
    words = ["job", "done", "user", "x1", "17", "4", "0x1f", "10.0.0.1", "a=b", "(ok)", "!!", "disk", "full"]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 5)))) for i in rng.sample(range(3 * n), n)]


@pytest.mark.parametrize("known", [(), ("job <*>", "<*> full", "user done")])
def test_sequential_equals_line_by_line(spark, known):
    from logloom.operators.sequential import parse_sequential
    lines = spark.createDataFrame(some_lines(5), "LineId long, Content string").repartition(4)
    rows = [tuple(r) for r in lines.select("LineId", "Content", T.propose_template(F.col("Content"))).collect()]
    templates = spark.createDataFrame(list(enumerate(known)), "template_id long, template string") if known else None
    out, born = parse_sequential(lines, templates)
    out = out.collect()
    assert {r.LineId: r.EventTemplate for r in out} == line_by_line(rows, known) and len(out) == len(rows)
    firsts = {}
    for r in sorted(out, key=lambda r: r.LineId):
        if r.EventTemplate is not None:
            firsts.setdefault(r.EventTemplate, f"E{len(firsts) + 1}")
    assert all(r.EventId == firsts.get(r.EventTemplate) for r in out)
    assert born.filter("born = -1").count() == len(known)


def test_sequential_by_dataset_and_empty(spark):
    from logloom.operators.sequential import parse_sequential
    lines = [(i, c, f"s{i % 2}") for i, c in some_lines(9, 120)]
    df = spark.createDataFrame(lines, "LineId long, Content string, dataset string")
    rows = df.select("LineId", "Content", T.propose_template(F.col("Content")), "dataset").collect()
    out, _ = parse_sequential(df, group_col="dataset")
    want = {}
    for s in ("s0", "s1"):
        want.update(line_by_line([tuple(r)[:3] for r in rows if r.dataset == s]))
    assert {r.LineId: r.EventTemplate for r in out.collect()} == want
    out, born = parse_sequential(df.limit(0), group_col="dataset")
    assert out.count() == 0 and born.count() == 0


def test_inverted_index_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(matching, "CROWDED", 2)
    rng = random.Random(3)
    words = ["a", "b", "c", "d", "<*>"]
    templates = sorted({" ".join(rng.choice(words) for _ in range(rng.randrange(1, 6))) for _ in range(150)})
    templates = [(i, t) for i, t in enumerate(templates) if set(brute_tokens(t)) != {"<*>"}]
    messages = sorted({" ".join(rng.choice(words[:4] + ["e"]) for _ in range(rng.randrange(1, 7))) for _ in range(200)})
    sigs = spark.createDataFrame([(signature(m),) for m in messages], "sig string")
    tp = matching.prepare_templates(spark.createDataFrame(templates, "template_id long, template string"))
    got = {(r.sig, r.template_id) for r in matching.all_matches(sigs, tp).collect()}
    assert got == {(signature(m), i) for m in messages for i, t in templates if pattern(brute_tokens(t)).match(signature(m))}
    for broadcast in (True, False):
        assert matching.best_match(sigs, tp, prepared=True, broadcast=broadcast).filter("template_id is not null").count() == len({s for s, _ in got})


def test_anchor_is_the_rarest_token(spark):
    tp = matching.prepare_templates(spark.createDataFrame([(1, "<*> common rare"), (2, "common common"), (3, "<*> common never")], "template_id long, template string"))
    sigs = spark.createDataFrame([(signature(m),) for m in ("x common rare", "common common", "y common", "z common")], "sig string")
    assert {r.template_id: r.anchor for r in matching.corpus_anchors(tp, sigs).collect()} == {1: "rare", 2: "common", 3: "never"}


def test_tokens_that_are_no_anchor_are_not_joined(spark, monkeypatch):
    """Without a broadcast, frequent tokens that anchor nothing stay in their tasks; hot anchors need no shuffle."""
    names, cut = [], matching.cut_lineage
    monkeypatch.setattr(matching, "cut_lineage", lambda df, name="cut": names.append((name, df.count())) or cut(df, name))
    msgs = [f"job {i} ended on host{i % 7} in room {i % 3}" for i in range(60)]
    sigs = spark.createDataFrame([(m,) for m in msgs], "m string").select(T.signature("m").alias("sig"))
    rows = [(i, f"job {i} ended on <*> in <*>") for i in range(0, 40)] + [(100, "<*> ended <*>"), (101, "<*> in room 2")]
    tpl = spark.createDataFrame(rows, "template_id long, template string")
    exp = {r["sig"]: r["template_id"] for r in matching.best_match(sigs, tpl, broadcast=True).collect()}
    assert set(exp.values()) >= {0, 39, 100}
    for hot in (5, 100_000):
        monkeypatch.setattr(matching, "HOT_ANCHOR", hot)
        names.clear()
        got = {r["sig"]: r["template_id"] for r in matching.best_match(sigs, tpl, broadcast=False).collect()}
        assert got == exp
    assert dict(names)["common-tokens"] > 0


def test_tokens_held_by_anchors(spark, monkeypatch):
    """Every token that is an anchor stays, few others do, at any size of the map of hashes."""
    tokens = spark.range(20_000).selectExpr("concat('t', id) AS m_tok", "id")
    anchors = spark.range(0, 20_000, 10).selectExpr("concat('t', id) AS anchor").unionByName(spark.createDataFrame([(None,)], "anchor string"))
    for most, others in ((1 << 22, 1800), (1024, 1800), (64, 18_000)):
        monkeypatch.setattr(matching, "ANCHOR_WORDS", most)
        monkeypatch.setattr(matching, "ROW_WORDS", min(most, 256))
        kept = {r.id for r in matching.held_by_anchors(tokens, anchors).collect()}
        assert kept >= set(range(0, 20_000, 10)) and len(kept) <= 2000 + others
