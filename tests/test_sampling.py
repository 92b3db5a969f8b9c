"""Samplers: quotas add up, draws stay in their cluster, greedy = brute force."""
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logloom.operators import sampling


def _docs(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select((F.col("doc_id") + 1).alias("row_id"), F.col("text").alias("Content"),
                    F.col("source").alias("EventTemplate"))


def test_quotas_sum_to_shot(spark, sf):
    cl = sampling.clusters(sampling.prepare(_docs(spark, sf)))
    q = sampling.quotas(cl)
    got = {r["shot"]: r["s"] for r in q.groupBy("shot").agg(F.sum("quota").alias("s")).collect()}
    assert got == {s: s for s in sampling.SHOTS}


def test_draws_are_members_and_counted(spark, sf):
    lab = _docs(spark, sf)
    cl = sampling.clusters(sampling.prepare(lab))
    q = sampling.quotas(cl, shots=[16])
    d = sampling.draw(cl, q)
    j = d.join(q.select("shot", "c_pos", "f_pos", "coarse", "fine"), ["shot", "c_pos", "f_pos"]) \
         .join(cl.select("row_id", F.col("coarse").alias("c2"), F.col("fine").alias("f2")), "row_id")
    assert j.filter((F.col("coarse") != F.col("c2")) | (F.col("fine") != F.col("f2"))).count() == 0
    assert d.count() == 16


def test_sampling_is_deterministic(spark, sf):
    lab = _docs(spark, sf)
    a = sorted(tuple(r) for r in sampling.hierarchical_sample(lab, shots=[8], share=None).select("sample_pos", "row_id").collect())
    b = sorted(tuple(r) for r in sampling.hierarchical_sample(lab, shots=[8], share=None).select("sample_pos", "row_id").collect())
    assert a == b and len(a) == 8


def _jac(a, b):
    ca, cb = Counter(a), Counter(b)
    if not a and not b:
        return 0.0
    if not a or not b:
        return 1.0
    i = sum((ca & cb).values())
    return 1 - i / (len(a) + len(b) - i)


def test_greedy_equals_brute_force():
    import pandas as pd
    rows = [(0, 1, 30, ["a", "b", "c"]), (1, 2, 10, ["a", "b"]), (1, 3, 12, ["x", "y"]), (2, 4, 5, ["a", "c"]),
            (2, 5, 5, ["q", "r", "s"]), (2, 3, 12, ["x", "y"])]
    pdf = pd.DataFrame(rows, columns=["round", "row_id", "orig_len", "words"]).assign(shot=3)
    got = list(sampling._greedy(pdf)["row_id"])
    picks = [1]
    for rnd in (1, 2):
        cand = sorted([r for r in rows if r[0] == rnd and r[1] not in picks], key=lambda r: (-r[2], r[1]))
        words = {r[1]: r[3] for r in rows}
        best = max(cand, key=lambda r: min(_jac(r[3], words[p]) for p in picks))
        picks.append(best[1])
    assert got == picks


def test_farthest_sample_distinct_picks(spark, sf):
    conv = spark.read.parquet(f"{sf}/conversations.parquet")
    lab = conv.select((F.col("conv_id") * 1000 + F.col("turn") + 1).alias("row_id"),
                      F.col("text").alias("Content"), F.col("role").alias("EventTemplate"))
    s = sampling.farthest_sample(lab, shots=[8], share=None)
    ids = [r["row_id"] for r in s.collect()]
    assert len(ids) == len(set(ids)) and 1 <= len(ids) <= 8


def test_draws_uniform_over_members(spark):
    """Brute force of the draw rule on one cluster: every index in [0, n)
    is reachable and draws match the stated member order."""
    rows = [(i, "c", "f") for i in range(1, 51)]
    cl = spark.createDataFrame(rows, "row_id long, coarse string, fine string")
    q = spark.createDataFrame([(128, "c", "f", 0, 0, 128, 50)],
                              "shot int, coarse string, fine string, c_pos int, f_pos int, quota int, size long")
    d = sampling.draw(cl, q).collect()
    assert len(d) == 128 and {r["draw"] for r in d} == set(range(1, 129))
    assert all(1 <= r["row_id"] <= 50 for r in d)
    assert len({r["row_id"] for r in d}) > 30   # with replacement, spread over the cluster


def test_many_datasets_in_one_job(spark, sf):
    """Datasets x shots in one job equals one job per dataset."""
    lab = _docs(spark, sf).withColumn("dataset", F.concat(F.lit("d"), (F.col("row_id") % 2).cast("string")))
    both = sampling.hierarchical_sample(lab, shots=[8, 16], share=None, group_col="dataset")
    got = sorted((r["dataset"], r["shot"], r["sample_pos"], r["row_id"]) for r in both.collect())
    exp = []
    for name in ("d0", "d1"):
        one = sampling.hierarchical_sample(lab.filter(F.col("dataset") == name).drop("dataset"),
                                           shots=[8, 16], share=None)
        exp += [(name, r["shot"], r["sample_pos"], r["row_id"]) for r in one.collect()]
    assert got == sorted(exp)
    cov = sampling.coverage(both, lab, share=None, group_col="dataset")
    assert cov.count() == 4


def _brute_greedy(rows):
    words = {r[1]: r[3] for r in rows}
    picks = [next(r[1] for r in rows if r[0] == 0)]
    for rnd in sorted({r[0] for r in rows} - {0}):
        cand = sorted([r for r in rows if r[0] == rnd and r[1] not in picks], key=lambda r: (-r[2], r[1]))
        if cand:
            picks.append(max(cand, key=lambda r: min(_jac(r[3], words[p]) for p in picks))[1])
    return picks


def test_lazy_greedy_equals_brute_force_on_random_pools():
    """Bounds, ties (equal texts and lengths) and rounds without a free candidate."""
    import random

    import pandas as pd
    for seed in range(30):
        rnd = random.Random(seed)
        lines = {i: (rnd.randint(5, 7), [rnd.choice("abcde") for _ in range(rnd.randint(2, 5))]) for i in range(1, 25)}
        rows = [(0, 1, *lines[1])] + [(r, i, *lines[i]) for r in range(1, 31) for i in lines if rnd.random() < 0.2]
        got = list(sampling._greedy(pd.DataFrame(rows, columns=["round", "row_id", "orig_len", "words"]))["row_id"])
        assert got == _brute_greedy(rows)


def test_candidates_are_drawn_at_their_rate(spark):
    """Every round takes about ``n_candidate`` of the lines, all of them where there are no more."""
    lines = spark.range(1, 4001).select(F.lit("d").alias("dataset"), F.col("id").alias("row_id"),
                                        F.lit("line of some words").alias("Content"))
    pool = sampling.candidate_pool(lines, rounds=40, n_candidate=100)
    sizes = {r["round"]: r["n"] for r in pool.groupBy("round").agg(F.count("*").alias("n")).collect()}
    assert sizes[0] == 1 and set(sizes) == set(range(41))
    assert 60 <= min(sizes[r] for r in range(1, 41)) and max(sizes.values()) <= 140
    assert 3800 <= sum(sizes.values()) <= 4200
    few = sampling.candidate_pool(lines.filter("row_id <= 50"), rounds=3, n_candidate=100)
    assert few.count() == 1 + 3 * 49


def test_farthest_by_dataset_and_shots(spark, sf):
    """One job for all datasets equals one job each, and a smaller shot begins a larger one."""
    conv = spark.read.parquet(f"{sf}/conversations.parquet")
    lab = conv.select(F.col("role").alias("dataset"), (F.col("conv_id") * 1000 + F.col("turn") + 1).alias("row_id"),
                      F.col("text").alias("Content"), F.col("role").alias("EventTemplate"))
    cols = ["shot", "sample_pos", "row_id"]
    both = sampling.farthest_sample(lab, shots=[4, 9], n_candidate=16, share=None, group_col="dataset").select("dataset", *cols)
    got = {tuple(r) for r in both.collect()}
    for name in ("user", "assistant"):
        one = sampling.farthest_sample(lab.filter(F.col("dataset") == name).drop("dataset"), shots=[4, 9],
                                       n_candidate=16, share=None).select(*cols)
        assert {t[1:] for t in got if t[0] == name} == {tuple(r) for r in one.collect()}
    for name, shot, pos, row in got:
        if shot == 4:
            assert (name, 9, pos, row) in got


def test_farthest_sample_of_nothing(spark):
    empty = spark.createDataFrame([], "row_id long, Content string, EventTemplate string, dataset string")
    assert sampling.farthest_sample(empty, shots=[8], share=None).count() == 0
    odd = spark.createDataFrame([(1, None, None, "a"), (2, "one", "one", "a"), (3, "two words", "two <*>", "a"),
                                 (4, "two words", "two <*>", None)],
                                "row_id long, Content string, EventTemplate string, dataset string")
    s = sampling.farthest_sample(odd, shots=[8], share=None, group_col="dataset").collect()
    assert [(r["dataset"], r["sample_pos"], r["row_id"]) for r in s] == [("a", 1, 3)]


@pytest.mark.parametrize("frequent", [0, 3, 50_000])
@pytest.mark.parametrize("group", [None, "dataset"])
def test_coarse_keys_equal_brute_force(spark, monkeypatch, frequent, group):
    """Whatever share of the vocabulary the tasks get; equal rows are one line; a line's words are not shuffled."""
    import random
    from collections import Counter
    monkeypatch.setattr(sampling, "FREQUENT", frequent)
    rng = random.Random(7)
    words = ["w" + c for c in "abcdefghijkl"]
    rows = [(rng.choice(["x", "y", None]), i, "f", [rng.choice(words) for _ in range(rng.choice([0, 1, 2, 6]))]) for i in range(60)]
    rows += rows[:5] + [("x", 3, "g", ["wz"]), ("x", None, "f", ["wa", "wb"]), ("x", None, "f", ["wc"])]
    df = spark.createDataFrame(rows, "dataset string, row_id long, fine string, vw array<string>")
    if not group:
        df = df.drop("dataset")
    got = sampling.coarse_keys(df, sampling.vocabulary(df, group), group)
    cnt = Counter((g if group else "", w) for g, _, _, ws in rows for w in ws)
    lines = {}
    for g, i, f, ws in rows:
        n = (lambda w: float("-inf")) if group and g is None else (lambda w: -cnt[g if group else "", w])
        lines.setdefault((g if group else None, i, f), []).extend((n(w), w) for w in set(ws))
    exp = {k: " ".join(sorted(w for _, w in sorted(t)[:3])) for k, t in lines.items()}
    assert {(r["dataset"] if group else None, r["row_id"], r["fine"]): r["coarse"] for r in got.collect()} == exp
    if frequent == 50_000 and not group:
        assert "explode" not in got._jdf.queryExecution().optimizedPlan().toString().lower()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_moved_only_when_cores_are_idle(spark):
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(0, cores * 5, 1, cores).select(F.col("id").alias("row_id"), F.lit("some words of it").alias("Content"))
    assert "Exchange" not in _plan(sampling.prepare(rows))            # every core has its rows
    assert "Exchange" in _plan(sampling.prepare(rows.coalesce(1))) or cores == 1


@pytest.mark.parametrize("limit", [0, 500_000])
def test_rare_words_meet_their_counts_in_any_plan(spark, monkeypatch, limit):
    monkeypatch.setattr(sampling, "FREQUENT", 1)
    monkeypatch.setattr(sampling, "BROADCAST_VOCAB_ROWS", limit)
    rows = [(1, ["aaa", "bbb", "ccc", "ddd"]), (2, ["aaa", "ddd"]), (3, ["eee"]), (4, []), (5, ["ddd", "ccc", "ccc"])]
    df = spark.createDataFrame([(i, "", w) for i, w in rows], "row_id long, fine string, vw array<string>")
    got = {r["row_id"]: r["coarse"] for r in sampling.coarse_keys(df, sampling.vocabulary(df)).collect()}
    counts = Counter(w for _, ws in rows for w in ws)
    assert got == {i: " ".join(sorted(sorted(set(ws), key=lambda w: (-counts[w], w))[:3])) for i, ws in rows}


def test_words_are_cut_at_specials(spark):
    from logloom.functions.text import sampler_words
    texts = ["..!a.!b!!c", ".! x9 y", "a.b! \t(c)=d|e;f@g", "", " ", None, "!.", "a..!!.b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    import re
    want = [None if t is None else [w for w in re.split(r"\s+", re.sub(r"""[:()=,"{}@\[\]|;]|\.?!""", " ", t)) if w and not re.search("[0-9]", w)] for t in texts]
    assert [r[0] for r in df.select(sampler_words("t")).collect()] == want
