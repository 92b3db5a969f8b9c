"""Labelled examples for a proposer.

Nearest examples without a cross join.  By word Jaccard it is a top-k
similarity join in rounds: the words of a text (each occurrence its own element) are
ordered by rarity among the examples, and two texts of a similarity of s share
one of their first ``n - ceil(s n) + 1`` elements and differ in length by a factor
of 1 / s at most.  The rounds lower s; a query is settled, and takes no further part,
as soon as its k-th best example so far reaches s, since no example that was
not compared can be nearer.  Each query left after the rounds takes the similarity of
its own k-th best as its last s; only those that still have fewer than k
meet all examples that share a word with them.

The other distances are exactly 1 (their maximum) for two texts that share
no word (LCS) or no character (Levenshtein, cosine, Ratcliff-Obershelp): their
candidates come from an equi-join on shared words or characters (plus an
empty-text key).  When a query has fewer than ``k`` candidates the rest of its
list is the lowest-position examples it shares nothing with, all at distance 1.
Those are found among the first ``2k`` examples by position, a list of bounded
size that is attached to each query as a literal array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.distance import distance
from logloom.functions.text import render_example_answer, render_example_query, words
from logloom.session import cut_lineage, ranked

CHAR_METHODS = {"levenshtein", "cosine", "ratcliff"}
#: The similarities of the rounds of the Jaccard join.
ROUNDS = (0.6, 0.25)


def _block_keys(col, method: str):
    units = F.array_remove(F.split(col, ""), "") if method in CHAR_METHODS else words(col)
    units = F.array_distinct(units)
    return F.when(F.size(units) == 0, F.array(F.lit(""))).otherwise(units)


def _elements(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, e): the word multiset, element ``w``, ``w#2`` .. for the occurrences of a word."""
    ws = df.select(key, F.explode(words(F.col(text_col))).alias("w")).groupBy(key, "w").agg(F.count("*").alias("c"))
    return ws.select(key, F.explode(F.transform(F.sequence(F.lit(1).cast("long"), "c"), lambda i: F.concat_ws("\x1f", "w", i.cast("string")))).alias("e"))


def _ordered(elements: DataFrame, key: str, ranks: DataFrame) -> DataFrame:
    """(key, es, n): the numbers of a text's elements that examples hold, rarest first, and its size."""
    known = elements.join(ranks, "e", "left")
    return known.groupBy(key).agg(F.array_sort(F.collect_list("r")).alias("es"), F.count("*").alias("n"))  # one text


def _prefix(s):
    """Length of the prefix of ``es`` in which two texts of similarity ``s`` (a column) meet; the elements that
    no example holds are rarest of all and stand before ``es``."""
    need = F.ceil(s * F.col("n") - F.lit(1e-9)).cast("int")
    return F.greatest(F.lit(0), F.col("n") - need + 1 - (F.col("n") - F.size("es"))).cast("int")


def _top(pairs: DataFrame, key_col: str, k: int) -> DataFrame:
    w = Window.partitionBy(key_col).orderBy("dist", "pos")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def jaccard_top(q: DataFrame, ex: DataFrame, k: int, key_col: str, query_col: str, rounds=ROUNDS) -> DataFrame:
    """(key, pos, dist): of the examples that share a word with a query, its ``k`` nearest by multiset
    Jaccard distance (ties by position)."""
    ee = cut_lineage(_elements(ex, "pos", "query"), "example-elements")
    ranks = ranked(ee.groupBy("e").agg(F.count("*").alias("df")), ["df", "e"], "r").select("e", "r")
    ranks = cut_lineage(ranks, "element-ranks")  # its size decides how it is joined
    es = cut_lineage(_ordered(ee, "pos", ranks).select("pos", F.col("es").alias("ee"), F.col("n").alias("le")), "example-sets")
    pending = cut_lineage(_ordered(_elements(q, key_col, query_col), key_col, ranks).filter(F.size("es") > 0)
                          .withColumn("kth", F.lit(None).cast("double")), "query-sets")
    done = []
    for s in (*rounds, None):
        if pending.isEmpty():
            break
        if s is None:  # each by the k-th similarity it has found
            own = F.coalesce(F.col("kth"), F.lit(0.0))
            mine, theirs = F.least(_prefix(own), F.size("es")), F.size("ee")
            near = (F.col("le") >= own * F.col("n") - 1e-9) & (F.col("n") >= own * F.col("le") - 1e-9)
        else:
            mine = _prefix(F.lit(s))
            theirs = F.greatest(F.lit(0), F.col("le") - F.ceil(F.lit(s) * F.col("le") - F.lit(1e-9)).cast("int") + 1).cast("int")
            near = (F.col("le") >= s * F.col("n") - 1e-9) & (F.col("n") >= s * F.col("le") - 1e-9)
        probe = pending.select(key_col, "n", "kth", F.explode(F.slice("es", 1, mine)).alias("e"))
        index = es.select("pos", "le", F.explode(F.slice("ee", 1, theirs)).alias("e"))
        met = probe.join(index, "e").filter(near).select(key_col, "pos").distinct()
        both = met.join(pending, key_col).join(es, "pos")
        shared = F.size(F.array_intersect("es", "ee"))
        both = both.select(key_col, "pos", (1.0 - shared.cast("double") / (F.col("n") + F.col("le") - shared)).alias("dist"))
        top = cut_lineage(_top(both, key_col, k).select(key_col, "pos", "dist", "rank"), "nearest-round")
        if s is None:
            done.append(top)
            break
        full = top.filter((F.col("rank") == k) & (F.col("dist") <= 1.0 - s + 1e-12)).select(key_col)
        done.append(top.join(full, key_col, "left_semi"))
        kth = top.filter(F.col("rank") == k).select(key_col, (1.0 - F.col("dist")).alias("kth"))
        pending = cut_lineage(pending.join(full, key_col, "left_anti").drop("kth").join(kth, key_col, "left"), "query-sets")
    out = q.sparkSession.createDataFrame([], q.select(key_col).schema.add("pos", "long").add("dist", "double"))
    for d in done:
        out = out.unionByName(d.select(key_col, F.col("pos").cast("long").alias("pos"), "dist"))
    return out


def nearest_pairs(queries: DataFrame, examples: DataFrame, k: int = 3, method: str = "jaccard",
                  key_col: str = "qid", query_col: str = "query_text") -> DataFrame:
    """C5 + E4 as rows: key, rank, pos, dist (ascending distance, ties by
    example position)."""
    ex = examples.select("pos", "query")
    q = queries.select(key_col, query_col)
    if method == "jaccard":
        cand = jaccard_top(q, ex, k, key_col, query_col)
        # two texts without words are at distance 0
        blank = [r["pos"] for r in ex.filter(F.size(words(F.col("query"))) == 0).orderBy("pos").limit(k).collect()]
        if blank:
            cand = cand.unionByName(q.filter(F.size(words(F.col(query_col))) == 0)
                                    .select(key_col, F.explode(F.array(*[F.lit(p).cast("long") for p in blank])).alias("pos"), F.lit(0.0).alias("dist")))
    else:
        qk = q.select(key_col, F.explode(_block_keys(F.col(query_col), method)).alias("_u"))
        ek = ex.select("pos", F.explode(_block_keys(F.col("query"), method)).alias("_u"))
        pairs = qk.join(ek, "_u").select(key_col, "pos").distinct()
        cand = (pairs.join(q, key_col).join(ex, "pos")
                .select(key_col, "pos", distance(method, F.col(query_col), F.col("query")).alias("dist")))
    first = [r["pos"] for r in ex.orderBy("pos").select("pos").limit(2 * k).collect()]
    fill = q.select(key_col, F.explode(F.array(*[F.lit(p) for p in first]) if first
                                        else F.array().cast("array<long>")).alias("pos"))
    fill = fill.join(cand.select(key_col, "pos"), [key_col, "pos"], "left_anti").withColumn("dist", F.lit(1.0))
    allp = cand.unionByName(fill)
    w = Window.partitionBy(key_col).orderBy("dist", "pos")
    return (allp.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select(key_col, "rank", "pos", "dist"))


def nearest_examples(queries: DataFrame, examples: DataFrame, k: int = 3, method: str = "jaccard",
                     key_col: str = "qid", query_col: str = "query_text") -> DataFrame:
    """One row per query: ``examples`` (rendered query/answer structs, G22),
    ``picked`` (positions) and ``dists``, in rank order."""
    top = nearest_pairs(queries, examples, k, method, key_col, query_col)
    top = top.join(examples.select("pos", "query", "answer"), "pos")
    return top.groupBy(key_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "query", "answer"))),
                    lambda e: F.struct(render_example_query(e["query"]).alias("query"),
                                       render_example_answer(e["answer"]).alias("answer"))).alias("examples"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "pos"))), lambda e: e["pos"]).alias("picked"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "dist"))), lambda e: e["dist"]).alias("dists"))


def random_examples(queries: DataFrame, examples: DataFrame, k: int = 3, seed: int = 0,
                    key_col: str = "qid") -> DataFrame:
    """K examples drawn with replacement for each query, by hash.

    Draw j of query q takes the example numbered
    ``m mod n`` in position order, m being the first 15 hex digits of
    ``md5("seed:q:j")`` (a hash that other engines have too)."""
    ex = examples.select("pos", "query", "answer")
    n = ex.count()
    ranked = ex.withColumn("_i", F.row_number().over(Window.orderBy("pos")) - 1)  # example table only
    draws = queries.select(key_col).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(k))))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key_col).cast("string"), F.col("draw").cast("string")).cast("binary"))
    draws = draws.withColumn("_i", (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % max(n, 1)).cast("int"))
    return draws.join(ranked, "_i").select(key_col, "draw", "pos", "query", "answer")
