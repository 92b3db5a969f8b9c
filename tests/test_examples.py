"""Distances and nearest examples against brute force."""
import difflib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logloom.functions import distance as D
from logloom.operators.examples import nearest_pairs

TEXTS = [("a b c a", "a c d"), ("", ""), ("x y", ""), ("same words", "same words"), ("é ü x", "ü é y z"),
         ("the quick brown fox", "the lazy brown dog"), ("Send 123", "Send 456")]


def lev(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def lcs(x, y):
    t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            t[i + 1][j + 1] = t[i][j] + 1 if x[i] == y[j] else max(t[i + 1][j], t[i][j + 1])
    return t[-1][-1]


def jac(a, b):
    a, b = a.split(), b.split()
    if not a and not b:
        return 0.0
    if not a or not b:
        return 1.0
    i = sum((Counter(a) & Counter(b)).values())
    return 1 - i / (len(a) + len(b) - i)


def cos(a, b):
    if a == b:
        return 0.0
    if not a or not b:
        return 1.0
    return 1 - sum((Counter(a) & Counter(b)).values()) / (len(a) * len(b)) ** 0.5


def test_distances(spark):
    df = spark.createDataFrame(TEXTS, "a string, b string")
    r = df.select(D.jaccard_text_distance("a", "b"), D.levenshtein_distance("a", "b"), D.cosine_distance("a", "b"),
                  D.lcs_distance("a", "b"), D.ratcliff_distance(F.col("a"), F.col("b"))).collect()
    for (a, b), row in zip(TEXTS, r):
        assert row[0] == pytest.approx(jac(a, b))
        assert row[1] == pytest.approx(lev(a, b) / max(len(a), len(b)) if max(len(a), len(b)) else 0.0)
        assert row[2] == pytest.approx(cos(a, b))
        wa, wb = a.split(), b.split()
        assert row[3] == pytest.approx(1 - (2 * lcs(wa, wb) / (len(wa) + len(wb)) if wa or wb else 0.0))
        exp_r = 0.0 if a == b else 1 - difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
        assert row[4] == pytest.approx(exp_r)


def test_merge_equal_length(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["a", "x", "c"])], "a array<string>, b array<string>")
    assert df.select(D.merge_equal_length("a", "b")).first()[0] == "a <*> c"


@pytest.mark.parametrize("method", ["jaccard", "levenshtein", "cosine"])
def test_nearest_equals_brute_force(spark, method):
    queries = ["a b c", "x", "", "b c d e", "zzz"]
    examples = ["a b", "c d", "", "q r s", "b c", "x x", "w"]
    q = spark.createDataFrame(list(enumerate(queries)), "qid long, query_text string")
    ex = spark.createDataFrame([(p, e, e) for p, e in enumerate(examples)], "pos long, query string, answer string")
    got = {}
    for r in nearest_pairs(q, ex, k=3, method=method).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["pos"]))
    fn = {"jaccard": jac, "levenshtein": lambda a, b: lev(a, b) / max(len(a), len(b)) if max(len(a), len(b)) else 0.0,
          "cosine": cos}[method]
    for qi, qt in enumerate(queries):
        exp = sorted(range(len(examples)), key=lambda p: (fn(qt, examples[p]), p))[:3]
        assert [p for _, p in sorted(got[qi])] == exp


@pytest.mark.parametrize("rounds", [(0.6, 0.25), (0.9, 0.5, 0.3, 0.1), ()])
def test_jaccard_join_equals_brute_force(spark, rounds):
    import random
    from logloom.operators.examples import jaccard_top
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(30)] + ["the"] * 30
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 14))) for _ in range(120)]
    queries = texts[:40] + [" ".join(t.split()[1:] + ["unseen"]) for t in texts[:40]] + ["only unseen words", "", "the " * 400]
    examples = texts[20:] + texts[30:40]  # ties
    q = spark.createDataFrame(list(enumerate(queries)), "qid long, query_text string").repartition(3)
    ex = spark.createDataFrame(list(enumerate(examples)), "pos long, query string").repartition(3)
    got = {}
    for r in jaccard_top(q, ex, 3, "qid", "query_text", rounds).collect():
        got.setdefault(r.qid, []).append((round(r.dist, 9), r.pos))
    for i, t in enumerate(queries):
        near = sorted((round(jac(t, e), 9), p) for p, e in enumerate(examples))
        want = [x for x in near if x[0] < 1 and t.split()][:3]
        assert sorted(got.get(i, [])) == want, t


def test_lcs_over_limbs(spark):
    import random
    rng = random.Random(1)
    sizes = [0, 1, 5, 61, 62, 63, 124, 125, 190]
    rows = [([rng.choice("abcdef") for _ in range(rng.choice(sizes))], [rng.choice("abcdefg") for _ in range(rng.choice(sizes))]) for _ in range(80)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    assert [r[0] for r in df.select(D.lcs_length("a", "b")).collect()] == [lcs(a, b) for a, b in rows]
