"""Choosing lines to label.

Hierarchical sampling
    words -> vocabulary counts (D15) -> per line the three most frequent
    words, sorted, as the coarse key (E3) -> special-character signature as
    the fine key (G9) -> quotas: ``shot`` spread over coarse clusters in a
    seeded hash order (E6), each coarse quota spread over its fine clusters
    by size (E5) -> draws with replacement inside a fine cluster (E7).

    A draw is a hashed index into the cluster's members (uniform, with
    replacement); members are spread over hash buckets of about a million
    rows and only buckets that hold a drawn index are ranked, so no cluster
    is ever gathered into one task however large it is, and the work stays
    linear in the members.  Only the at most ``shot`` coarse clusters with a
    quota are ranked (a top-k, not a global sort).

Farthest-point sampling
    The first pick is the line with most words (then longest) - a
    ``max_by`` per dataset.  Each later round looks at about ``n_candidate``
    random lines and takes the one farthest (Jaccard on words) from everything
    picked so far.  A line is a candidate of a round with probability
    ``n_candidate / n``, so the gaps between its rounds are geometric: one hash
    a line gives its first round, and only the lines whose first round comes
    before the last one are cleaned and draw again.  The greedy runs once for
    each dataset; a smaller shot is the beginning of a larger one.  Its pool
    has about ``rounds * n_candidate`` lines however many the dataset has.

All draws are hashes by md5 (``_hash``), which other engines have too.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from logloom.functions.text import (SAMPLER_STOPWORDS, farthest_clean, sampler_signature, sampler_words,
                                    words)

SHOTS = [8, 16, 32, 64, 128]
#: Words of lines that are looked up, up to which they are broadcast.
BROADCAST_VOCAB_ROWS = 500_000


def _gl(group_col):
    return [group_col] if group_col else []


def _hash(*parts):
    """The first 60 bits of ``md5`` of the parts joined by colons, as a long."""
    text = F.concat_ws(":", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def first_share(labelled: DataFrame, share: float = 0.2, order_col: str = "row_id",
                group_col: str | None = None) -> DataFrame:
    """B2: the first ``share`` of the rows (``row_id`` is 1-based), per dataset."""
    G = _gl(group_col)
    if not G:
        n = labelled.count()
        return labelled.filter(F.col(order_col) <= int(share * n))
    counts = labelled.groupBy(*G).agg(F.count("*").alias("_n"))   # one row per dataset
    return labelled.join(F.broadcast(counts), G).filter(F.col(order_col) <= F.floor(F.col("_n") * share)).drop("_n")


def prepare(labelled: DataFrame, content_col: str = "Content", id_col: str = "row_id",
            group_col: str | None = None) -> DataFrame:
    """G9 + B4: cleaned words and signature; keep lines with > 1 cleaned word.

    ``ws`` holds the cleaned words (split once); ``clean`` is their text."""
    from logloom.session import spread_if_idle
    x = spread_if_idle(labelled.select(*_gl(group_col), F.col(id_col).alias("row_id"), F.col(content_col).alias("_c")))
    # exploded (one row a line, none without two words): the words are not split again for the filter
    enough = F.filter(F.array(sampler_words("_c")), lambda w: F.size(w) > 1)
    x = x.select("*", F.explode(enough).alias("ws")).withColumn("fine", sampler_signature("_c")).drop("_c")
    return x.withColumn("clean", F.array_join("ws", " "))


def _vocab_filter(ws):
    return F.filter(ws, lambda w: (F.length(w) > 2) & ~w.isin(*SAMPLER_STOPWORDS))


def vocabulary(prepared: DataFrame, group_col: str | None = None) -> DataFrame:
    """Counts of words longer than two characters, stopwords removed."""
    G = _gl(group_col)
    vw = F.col("vw") if "vw" in prepared.columns else _vocab_filter(F.col("ws"))
    return prepared.select(*G, F.explode(vw).alias("token")).groupBy(*G, "token").agg(F.count("*").alias("cnt"))


#: Words of the vocabulary that every task gets to find the most frequent words of its lines.
FREQUENT = 50_000
_TOP_TYPE = "array<struct<n:bigint,token:string>>"


def _frequent_words(first: list[tuple], line: list[str], grouped: bool):
    """A function for ``mapInArrow`` over lines (``line`` columns, vw, _g): the best three of the words ``first`` (group,
    token, count, best first) in each line as ``t``, and whether they are the best of all its words (``settled``); the
    words ``vw`` stay on lines that are not settled.  ``grouped``: the group counts as a part of the word."""
    k = len(first) + 1

    def fn(batches):
        known = pa.array([f"{g}\x1f{token}" if grouped else token for g, token, _ in first], pa.string())
        tokens = pa.array([token for _, token, _ in first], pa.string())
        counts = np.array([-cnt for _, _, cnt in first], dtype="int64")
        for batch in batches:
            vw, n = batch.column("vw"), batch.num_rows
            lens = pc.fill_null(pc.list_value_length(vw), 0).to_numpy(zero_copy_only=False).astype("int64")
            row = np.repeat(np.arange(n), lens)
            words_of = pc.list_flatten(vw)
            keys = words_of.cast(pa.string())
            if grouped:
                keys = pc.binary_join_element_wise(batch.column("_g").take(pa.array(row)).cast(pa.string()), keys, "\x1f")
            place = pc.fill_null(pc.index_in(keys, value_set=known), -1).to_numpy(zero_copy_only=False).astype("int64")
            lacks = np.bincount(row[place < 0], minlength=n) > 0
            code = np.unique(row[place >= 0] * k + place[place >= 0])  # distinct words of a line, best first
            of, word = code // k, code % k
            size = np.bincount(of, minlength=n)
            kept = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) < 3
            offsets = np.concatenate([[0], np.cumsum(np.minimum(size, 3))]).astype("int32")
            best = pa.StructArray.from_arrays([pa.array(counts[word[kept]]), tokens.take(pa.array(word[kept]))], ["n", "token"])
            settled = pa.array((size >= 3) | ~lacks)
            left = pc.if_else(settled, pa.scalar(None, vw.type), vw)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in line], left, settled, pa.ListArray.from_arrays(pa.array(offsets), best)],
                                             names=[*line, "vw", "settled", "t"])
    return fn


def coarse_keys(prepared: DataFrame, vocab: DataFrame, group_col: str | None = None) -> DataFrame:
    """The three most frequent (vocabulary count) distinct words of each
    line, ties by word, returned sorted and joined with a space.

    The ``FREQUENT`` first words of the vocabulary in that order go to every task, which finds
    them in its lines: a line with three of them, or with no other words, is settled there.  The words of
    all other lines meet their counts in a join; the vocabulary is cut to them first, unless they are
    more than ``BROADCAST_VOCAB_ROWS``.  Only three words a line are shuffled, so that lines of one key are one line."""
    from logloom.session import cut_lineage
    G = _gl(group_col)
    vw = F.col("vw") if "vw" in prepared.columns else _vocab_filter(F.col("ws"))
    rest = [c for c in prepared.columns if c not in {*G, "row_id", "vw", "ws"}]  # carried through, not joined back
    line = [*G, "row_id", *rest]
    counted = vocab.filter(F.col(group_col).isNotNull()) if G else vocab  # null is equal to no dataset
    name = F.col(group_col).cast("string") if G else F.lit("")
    first = counted.orderBy(F.col("cnt").desc(), "token", *G).limit(FREQUENT).select(name.alias("g"), "token", "cnt").collect()
    lines = prepared.select(*line, vw.alias("vw"), name.alias("_g"))
    out = StructType([*[lines.schema[c] for c in line], *StructType.fromDDL(f"vw array<string>, settled boolean, t {_TOP_TYPE}").fields])
    found = cut_lineage(lines.mapInArrow(_frequent_words([tuple(r) for r in first], line, bool(G)), out), "frequent-words")
    tops = found.filter("settled").select(*line, "t")
    others = found.filter("NOT settled")
    if not others.isEmpty():
        toks = others.select(*line, F.explode_outer(F.array_distinct("vw")).alias("token"))
        side = vocab
        needed = toks.select(*G, "token").where("token IS NOT NULL").distinct().limit(BROADCAST_VOCAB_ROWS + 1)
        needed = cut_lineage(needed, "needed-words")
        if needed.count() <= BROADCAST_VOCAB_ROWS:  # the few words of these lines go to the vocabulary, not it to them
            side = vocab.join(F.broadcast(needed), G + ["token"], "left_semi")
        word = F.when(F.col("token").isNotNull(), F.struct((-F.col("cnt")).alias("n"), F.col("token")))
        j = toks.join(side, G + ["token"], "left")
        tops = tops.unionByName(j.groupBy(*line).agg(F.slice(F.array_sort(F.collect_list(word)), 1, 3).alias("t")))
    top = tops.groupBy(*line).agg(F.slice(F.array_sort(F.flatten(F.collect_list("t"))), 1, 3).alias("t"))
    return top.select(*line, F.array_join(F.array_sort(F.transform("t", lambda e: e["token"])), " ").alias("coarse"))


def clusters(prepared: DataFrame, group_col: str | None = None) -> DataFrame:
    """Rows with their coarse and fine cluster keys (written once: every
    later step reads this table)."""
    from logloom.session import cut_lineage
    G = _gl(group_col)
    # the text is cleaned once: the vocabulary words of every line are written
    words_tab = cut_lineage(prepared.select(*G, "row_id", "fine", _vocab_filter(F.col("ws")).alias("vw")), "vocab-words")
    vocab = cut_lineage(vocabulary(words_tab, group_col), "vocab")
    return cut_lineage(coarse_keys(words_tab, vocab, group_col).select(*G, "row_id", "coarse", "fine"), "clusters")


def fine_sizes(clustered: DataFrame, group_col: str | None = None) -> DataFrame:
    """Rows per (coarse, fine)."""
    return clustered.groupBy(*_gl(group_col), "coarse", "fine").agg(F.count("*").alias("size"))


def coarse_sizes(clustered: DataFrame, group_col: str | None = None) -> DataFrame:
    """Rows per coarse key."""
    return clustered.groupBy(*_gl(group_col), "coarse").agg(F.count("*").alias("size"))


def cluster_totals(clustered: DataFrame, group_col: str | None = None) -> DataFrame:
    """Number of coarse and fine clusters."""
    G = _gl(group_col)
    f = fine_sizes(clustered, group_col)
    aggs = [F.countDistinct("coarse").alias("n_coarse"), F.count("*").alias("n_fine")]
    return f.groupBy(*G).agg(*aggs) if G else f.agg(*aggs)


def _coarse_order(seed: int, order: str):
    return F.col("coarse") if order == "key" else _hash(seed, F.col("coarse"))


TOPK_SALT = 64


def quotas(clustered: DataFrame, shots=SHOTS, seed: int = 0, order: str = "hash",
           group_col: str | None = None) -> DataFrame:
    """E6 + E5 for every shot (P9): ``shot, coarse, fine, c_pos, f_pos, quota``.

    Coarse clusters are ordered by the hash of ``seed:coarse`` (or by key with
    ``order="key"``); quota ``shot // C + (pos < shot % C)``.  Fine clusters
    by size descending, then key; quota ``cq // F + (pos < cq % F)``.  Only the
    first ``max(shots)`` coarse clusters can get a quota: a top-k (per
    dataset a salted two-phase top-k, so no dataset's clusters meet in one
    task)."""
    G = _gl(group_col)
    shots = list(shots)
    max_shot = max(shots)
    fs = fine_sizes(clustered, group_col)
    cs = fs.groupBy(*G, "coarse").agg(F.sum("size").alias("size"), F.count("*").alias("n_fine"))
    cs = cs.withColumn("_o", _coarse_order(seed, order))
    if not G:
        n_coarse = cs.count()
        top = cs.orderBy("_o", "coarse").limit(max_shot)
        top = top.withColumn("c_pos", F.row_number().over(Window.orderBy("_o", "coarse")) - 1)  # <= max_shot rows
        top = top.withColumn("n_coarse", F.lit(max(n_coarse, 1)))
    else:
        nc = cs.groupBy(*G).agg(F.count("*").alias("n_coarse"))            # one row per dataset
        salted = cs.withColumn("_b", F.pmod(F.xxhash64(F.col("coarse")), F.lit(TOPK_SALT)))
        w1 = Window.partitionBy(*G, "_b").orderBy("_o", "coarse")
        pre = salted.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= max_shot)
        w2 = Window.partitionBy(*G).orderBy("_o", "coarse")                # <= salt * max_shot rows each
        top = pre.withColumn("_r", F.row_number().over(w2)).filter(F.col("_r") <= max_shot).withColumn("c_pos", F.col("_r") - 1)
        top = top.join(F.broadcast(nc), G).drop("_b", "_r")
    top = top.withColumn("shot", F.explode(F.array(*[F.lit(x) for x in shots])))
    c = F.col("n_coarse")
    top = top.withColumn("c_quota", (F.floor(F.col("shot") / c) + (F.col("c_pos") < F.pmod(F.col("shot"), c)).cast("int"))
                         .cast("int")).filter(F.col("c_quota") > 0)
    fr = fs.join(F.broadcast(top.select(*G, "coarse").distinct()), G + ["coarse"])
    # filtered as a rank, so that every task keeps the first max_shot rows of a cluster before they meet
    fr = fr.withColumn("_r", F.row_number().over(
        Window.partitionBy(*G, "coarse").orderBy(F.col("size").desc(), F.col("fine"))))
    fr = fr.filter(F.col("_r") <= max_shot).withColumn("f_pos", F.col("_r") - 1).drop("_r")
    j = top.select(*G, "shot", "coarse", "c_pos", "c_quota", "n_fine").join(fr, G + ["coarse"])
    nf = F.col("n_fine")
    j = j.withColumn("quota", (F.floor(F.col("c_quota") / nf) + (F.col("f_pos") < F.pmod(F.col("c_quota"), nf)).cast("int"))
                     .cast("int"))
    return j.filter(F.col("quota") > 0).select(*G, "shot", "coarse", "fine", "c_pos", "f_pos", "c_quota", "quota", "size")


BUCKET_ROWS = 1_000_000


def draw(clustered: DataFrame, quota_table: DataFrame, seed: int = 0, group_col: str | None = None) -> DataFrame:
    """``quota`` members of each chosen fine cluster, with replacement.

    Draw j of a cluster of size n takes the member at index
    ``hash(seed:shot:coarse:fine:j) % n`` in a fixed member order (bucket, then
    the hash ``h`` of ``seed:row_id``, then row_id): members are spread over ``ceil(n / BUCKET_ROWS)`` buckets by ``h``, bucket
    sizes give each bucket's first index, and only the buckets that hold a
    drawn index (at most the sum of the shots) are ranked, so no cluster is
    gathered into one task and the work is linear in the members.

    Returns ``shot, c_pos, f_pos, draw, row_id`` (sample order)."""
    G = _gl(group_col)
    K = G + ["coarse", "fine"]
    q = quota_table.select(*G, "shot", "coarse", "fine", "c_pos", "f_pos", "quota", "size")
    sizes = q.select(*K, "size").distinct()
    nb = F.greatest(F.lit(1), F.ceil(F.col("size") / BUCKET_ROWS)).cast("long")
    members = (clustered.select(*K, "row_id").join(F.broadcast(sizes), K)
               .withColumn("h", _hash(seed, F.col("row_id"))).withColumn("bucket", F.pmod(F.col("h"), nb)))
    counts = members.groupBy(*K, "bucket").agg(F.count("*").alias("cnt"))
    w = Window.partitionBy(*K).orderBy("bucket")
    counts = counts.withColumn("start", F.sum("cnt").over(w) - F.col("cnt"))
    targets = q.withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("quota"))))
    targets = targets.withColumn("t", F.pmod(_hash(seed, F.col("shot"), F.col("coarse"), F.col("fine"), F.col("draw")), F.col("size")))
    located = (targets.join(counts, K)
               .filter((F.col("t") >= F.col("start")) & (F.col("t") < F.col("start") + F.col("cnt")))
               .withColumn("idx", F.col("t") - F.col("start")))
    needed = located.select(*K, "bucket").distinct()
    picked = members.join(F.broadcast(needed), K + ["bucket"])
    wm = Window.partitionBy(*K, "bucket").orderBy("h", "row_id")
    picked = picked.withColumn("idx", F.row_number().over(wm) - 1)
    return located.join(picked.select(*K, "bucket", "idx", "row_id"), K + ["bucket", "idx"]) \
        .select(*G, "shot", "c_pos", "f_pos", "draw", "row_id")


def hierarchical_sample(labelled: DataFrame, shots=SHOTS, seed: int = 0, order: str = "hash",
                        share: float | None = 0.2, content_col: str = "Content",
                        template_col: str = "EventTemplate", group_col: str | None = None) -> DataFrame:
    """The whole hierarchical sampler for every shot (B2, B4, B13, E13), and
    for every dataset at once with ``group_col`` (P9).

    ``labelled`` has ``row_id`` (1-based order, per dataset), Content and
    EventTemplate.  Returns ``shot, sample_pos, row_id, query, answer``
    (answer with ``{variables}``, G29)."""
    from logloom.functions.text import wildcards_to_placeholder
    from logloom.session import cut_lineage
    G = _gl(group_col)
    base = first_share(labelled, share, group_col=group_col) if share else labelled
    prepared = prepare(base, content_col, group_col=group_col)
    cl = clusters(prepared, group_col)
    qt = quotas(cl, shots, seed, order, group_col)
    d = draw(cl, qt, seed, group_col)
    w = Window.partitionBy(*G, "shot").orderBy("c_pos", "f_pos", "draw")
    d = d.withColumn("sample_pos", F.row_number().over(w)).filter(F.col("sample_pos") <= F.col("shot"))
    d = cut_lineage(d, "draws")                        # at most the sum of the shots a dataset
    rows = base.select(*G, "row_id", F.col(content_col).alias("query"),
                       wildcards_to_placeholder(F.col(template_col)).alias("answer"),
                       F.col(template_col).alias("template"))
    return d.join(rows, G + ["row_id"]).select(*G, "shot", "sample_pos", "row_id", "query", "answer", "template")


def coverage(samples: DataFrame, labelled: DataFrame, share: float | None = 0.2,
             template_col: str = "EventTemplate", group_col: str | None = None) -> DataFrame:
    """D19 + D24 + F5: distinct templates sampled, and that over
    ``min(distinct templates, shot)``."""
    G = _gl(group_col)
    base = first_share(labelled, share, group_col=group_col) if share else labelled
    s = samples.groupBy(*G, "shot").agg(F.countDistinct("template").alias("covered"))
    if G:
        n_t = base.groupBy(*G).agg(F.countDistinct(template_col).alias("n_templates"))  # one row per dataset
        s = s.join(F.broadcast(n_t), G)
    else:
        n_t = base.agg(F.countDistinct(template_col).alias("n")).first()["n"]  # one number
        s = s.withColumn("n_templates", F.lit(n_t))
    return s.withColumn("coverage", F.round(F.col("covered") / F.least(F.col("n_templates"), F.col("shot")), 6))


def mean_by_shot(stats: DataFrame) -> DataFrame:
    """Mean coverage (and any other numeric column) per shot over datasets."""
    cols = [c for c in stats.columns if c not in ("shot", "dataset")]
    return stats.groupBy("shot").agg(*[F.avg(c).alias(c) for c in cols])


# ---------------------------------------------------------------------------
# Farthest-point sampling
# ---------------------------------------------------------------------------

def _jaccard(a: Counter, la: int, b: Counter, lb: int) -> float:
    if la == 0 and lb == 0:
        return 0.0
    if la == 0 or lb == 0:
        return 1.0
    small, big = (a, b) if len(a) < len(b) else (b, a)
    inter = sum(min(c, big[w]) for w, c in small.items() if w in big)
    return 1.0 - inter / (la + lb - inter)


def _greedy(pdf: pd.DataFrame) -> pd.DataFrame:
    """Farthest-point picks on a pool of candidates (``round, row_id, orig_len, words``; round 0 is the first pick).

    The distance of a line to its nearest pick only falls as picks are added, so the last known value
    bounds it: candidates go by falling bound, each is compared with the picks it has not met until it
    falls behind the best, and a round ends at the first bound below the best.  Ties go to the longer
    line, then to the smaller row_id."""
    lines = pdf.drop_duplicates("row_id").sort_values(["orig_len", "row_id"], ascending=[False, True])
    rank = {int(r): i for i, r in enumerate(lines["row_id"])}
    texts = {int(r): Counter(w) for r, w in zip(lines["row_id"], lines["words"])}
    lens = {r: sum(c.values()) for r, c in texts.items()}
    picks = [int(pdf.loc[pdf["round"] == 0, "row_id"].iloc[0])]
    rounds, chosen = [0], set(picks)
    known: dict[int, tuple[float, int]] = {}          # distance to the first so many picks
    drawn = {int(r): [int(x) for x in g] for r, g in pdf.groupby("round")["row_id"]}
    for rnd in sorted(r for r in drawn if r > 0):
        best, best_d = None, -1.0
        cand = [(known.get(r, (float("inf"), 0)), rank[r], r) for r in drawn[rnd] if r not in chosen]
        for (d, met), place, r in sorted(cand, key=lambda c: (-c[0][0], c[1])):
            if d < best_d:
                break
            while met < len(picks) and (d > best_d or d == best_d and place < rank[best]):
                d = min(d, _jaccard(texts[r], lens[r], texts[picks[met]], lens[picks[met]]))
                met += 1
            known[r] = (d, met)
            if d > best_d or d == best_d and place < rank[best]:
                best, best_d = r, d
        if best is not None:
            picks.append(best)
            rounds.append(rnd)
            chosen.add(best)
    return pd.DataFrame({"round": rounds, "sample_pos": list(range(1, len(picks) + 1)), "row_id": picks})


def _gap(k, n_candidate: int, seed: int):
    """Rounds from a line's candidacy k - 1 to its candidacy k: geometric with mean ``n / n_candidate``."""
    u = (_hash(seed, F.col("row_id"), k) + 1) / F.lit(float(16 ** 15))
    gap = F.floor(F.ln(u) / F.ln(1 - F.lit(float(n_candidate)) / F.col("n"))) + 1
    return F.when(F.col("n") <= n_candidate, F.lit(1)).otherwise(gap).cast("long")


def candidate_pool(base: DataFrame, rounds: int, n_candidate: int = 128, seed: int = 0,
                   content_col: str = "Content", group_col: str = "dataset") -> DataFrame:
    """The lines of each dataset drawn as candidates: ``group, round, row_id, orig_len, words``; round 0 is the
    first pick, rounds 1 to ``rounds`` follow.

    Lines with fewer than two cleaned words take no part.  The statistics (one row a dataset) are written, so
    that their size decides how they are joined."""
    from logloom.session import cut_lineage
    x = base.select(group_col, "row_id", F.col(content_col).alias("_c"))
    cleaned = x.withColumn("words", words(farthest_clean("_c"))).withColumn("orig_len", F.length("_c")).drop("_c")
    cleaned = cleaned.filter(F.size("words") > 1)
    stats = cut_lineage(cleaned.groupBy(group_col).agg(
        F.count("*").alias("n"),
        F.max_by("row_id", F.struct(F.size("words"), F.col("orig_len"), -F.col("row_id"))).alias("first")), "farthest-stats")
    drawn = x.join(stats, group_col).withColumn("at", _gap(F.lit(1), n_candidate, seed))
    drawn = drawn.filter((F.col("at") <= rounds) | (F.col("row_id") == F.col("first")))
    later = F.aggregate(
        F.sequence(F.lit(2), F.lit(max(rounds, 2))),
        F.struct(F.col("at").alias("at"), F.array("at").alias("all")),
        lambda acc, k: F.when(acc["at"] >= rounds, acc).otherwise(F.struct(
            (acc["at"] + _gap(k, n_candidate, seed)).alias("at"),
            F.array_append(acc["all"], acc["at"] + _gap(k, n_candidate, seed)).alias("all"))))["all"]
    start = F.when(F.col("row_id") == F.col("first"), F.array(F.lit(0).cast("long")))
    drawn = drawn.withColumn("round", F.explode(F.coalesce(start, F.filter(later, lambda r: r <= rounds))))
    return drawn.select(group_col, F.col("round").cast("int").alias("round"), "row_id", F.length("_c").alias("orig_len"),
                        words(farthest_clean("_c")).alias("words")).filter(F.size("words") > 1)


def farthest_sample(labelled: DataFrame, shots=SHOTS, n_candidate: int = 128, seed: int = 0,
                    share: float | None = 0.2, content_col: str = "Content",
                    template_col: str = "EventTemplate", group_col: str | None = None) -> DataFrame:
    """Farthest-point samples for every shot, and for every dataset at once with ``group_col``.

    ``row_id`` is unique in its dataset.  Returns ``shot, sample_pos, row_id, query, answer`` (answer keeps
    ``<*>``).  A dataset with less than two lines left in a round gives fewer picks than the shot."""
    from logloom.session import cut_lineage
    G = _gl(group_col)
    base = first_share(labelled, share, group_col=group_col) if share else labelled
    key = group_col or "_all"
    grouped = base if group_col else base.withColumn(key, F.lit(0))
    pool = candidate_pool(grouped, max(shots) - 1, n_candidate, seed, content_col, key)
    out = StructType([pool.schema[key], *StructType.fromDDL("round int, sample_pos int, row_id long").fields])
    picks = pool.groupBy(key).applyInPandas(lambda k, pdf: _greedy(pdf).assign(**{key: k[0]})[out.names], out)
    picks = cut_lineage(picks, "farthest-picks")       # at most max(shots) rows a dataset
    picks = picks.withColumn("shot", F.explode(F.array(*[F.lit(s) for s in shots]))).filter(F.col("round") < F.col("shot"))
    rows = base.select(*G, "row_id", F.col(content_col).alias("query"), F.col(template_col).alias("answer"))
    return picks.join(rows, G + ["row_id"]).select(*G, "shot", "sample_pos", "row_id", "query", "answer",
                                                   F.col("answer").alias("template"))
