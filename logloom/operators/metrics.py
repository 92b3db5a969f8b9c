"""Parse scores against ground truth.

Every metric comes from one table ``pairs(group..., gt, parsed, n)`` =
rows per (truth template, parsed template): one shuffle of the line table,
partially aggregated map-side, after which everything works on a table whose
size is the number of distinct template pairs.  ``group`` (e.g. ``dataset``)
is a leading key everywhere, so many datasets are scored in one job (P8).

Nulls follow the reference: grouping and template scores drop rows with a
NULL truth; PA keeps them (as wrong); a missing parse is ``''``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.text import is_abstract, relaxed_equal, token_similarity, wildcard_count

METRICS = ["GA", "PA", "FGA", "PTA", "RTA", "FTA"]


def _g(group_cols):
    return [group_cols] if isinstance(group_cols, str) else list(group_cols)


def _div(a, b):
    return F.when(b != 0, a.cast("double") / b)


def _f1(p, r):
    return F.when(p.isNull() | r.isNull(), F.lit(None).cast("double")).when(
        (p != 0) | (r != 0), 2 * p * r / (p + r)).otherwise(F.lit(0.0))


# ---------------------------------------------------------------------------
# Alignment and counts
# ---------------------------------------------------------------------------

def align(truth: DataFrame, parsed: DataFrame, keys=("dataset", "LineId"),
          truth_col: str = "EventTemplate", parsed_col: str = "EventTemplate") -> DataFrame:
    """Truth rows with their parse (left join on the line key); a
    missing parse becomes ``''`` (A6)."""
    keys = list(keys)
    t = truth.select(*keys, F.col(truth_col).alias("gt"))
    p = parsed.select(*keys, F.col(parsed_col).alias("parsed"))
    return t.join(p, keys, "left").withColumn("parsed", F.coalesce("parsed", F.lit("")))


def pair_counts(aligned: DataFrame, group_cols=("dataset",)) -> DataFrame:
    """Rows per (gt, parsed), written once: every score reads this table instead of the lines."""
    from logloom.session import cut_lineage
    return cut_lineage(aligned.groupBy(*_g(group_cols), "gt", "parsed").agg(F.count("*").alias("n")), "pairs")


def value_counts(aligned: DataFrame, col: str, group_cols=("dataset",)) -> DataFrame:
    """Rows per template."""
    return aligned.groupBy(*_g(group_cols), col).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------------------
# Template bands
# ---------------------------------------------------------------------------

def complexity_band(templates: DataFrame, level: int, template_col: str = "EventTemplate",
                    compat: bool = False) -> DataFrame:
    """1 -> no wildcard, 2 -> 1 to 4, 3 -> 5 or more."""
    c = wildcard_count(F.col(template_col), compat)
    cond = {1: c == 0, 2: (c >= 1) & (c <= 4), 3: c >= 5}[level]
    return templates.filter(cond)


def frequency_band(templates: DataFrame, pct: int, group_cols=(), template_col: str = "EventTemplate",
                   occ_col: str = "Occurrences") -> DataFrame:
    """Lowest ``pct`` % of templates by occurrences (pct > 0) or the
    highest ``-pct`` % (pct < 0); ties by template text."""
    g = _g(group_cols)
    w = Window.partitionBy(*g).orderBy(occ_col, template_col) if g else Window.orderBy(occ_col, template_col)
    wc = Window.partitionBy(*g) if g else Window.partitionBy()
    t = templates.withColumn("_pos", F.row_number().over(w)).withColumn("_cnt", F.count("*").over(wc))
    if pct > 0:
        keep = F.col("_pos") <= F.floor(F.col("_cnt") / 100.0 * pct)
    else:
        keep = F.col("_pos") > F.col("_cnt") - F.floor(F.col("_cnt") / 100.0 * (-pct))
    return t.filter(keep).drop("_pos", "_cnt")


# ---------------------------------------------------------------------------
# Grouping accuracy
# ---------------------------------------------------------------------------

def _band_parts(band: DataFrame | None, g, template_col):
    if band is None:
        return None, None
    b = band.select(*g, F.col(template_col).alias("gt"))
    band_set = b.distinct().withColumn("_in_band", F.lit(True))
    band_len = b.groupBy(*g).agg(F.count("*").alias("band_len")) if g else \
        b.agg(F.count("*").alias("band_len"))
    return band_set, band_len


def _join_g(left: DataFrame, right: DataFrame, g, how="left"):
    """Combine per-group scalar tables (one row per group) without a join:
    union them and take the non-null value of every column per group."""
    return _combine(g, left, right)


def _combine(g, *dfs: DataFrame) -> DataFrame:
    u = dfs[0]
    for d in dfs[1:]:
        u = u.unionByName(d, allowMissingColumns=True)
    cols = [c for c in u.columns if c not in g]
    aggs = [F.first(c, ignorenulls=True).alias(c) for c in cols]
    return u.groupBy(*g).agg(*aggs) if g else u.agg(*aggs)


def group_table(pairs: DataFrame, group_cols=("dataset",)) -> DataFrame:
    """Per truth template: size, number of parsed templates, and whether it is
    a correct group (one parsed template whose rows are exactly this group)."""
    g = _g(group_cols)
    q = pairs.filter(F.col("gt").isNotNull())
    per_gt = q.groupBy(*g, "gt").agg(F.sum("n").alias("size_g"), F.count("*").alias("k"),
                                     F.min("parsed").alias("parsed"))
    per_p = q.groupBy(*g, "parsed").agg(F.sum("n").alias("size_p"))
    j = per_gt.join(per_p, g + ["parsed"], "left")
    return j.withColumn("correct", (F.col("k") == 1) & (F.col("size_g") == F.col("size_p")))


def grouping_accuracy(pairs: DataFrame, band: DataFrame | None = None, group_cols=("dataset",),
                      template_col: str = "EventTemplate") -> DataFrame:
    """GA, PGA, RGA, FGA per group; with ``band`` only truth
    templates in the band count (list length as RGA denominator)."""
    g = _g(group_cols)
    gt_tab = group_table(pairs, g)
    q = pairs.filter(F.col("gt").isNotNull())
    if band is None:
        a = gt_tab.groupBy(*g).agg(
            F.sum(F.when(F.col("correct"), F.col("size_g")).otherwise(0)).alias("acc_events"),
            F.sum("size_g").alias("n_rows"),
            F.count_if(F.col("correct")).alias("n_correct"),
            F.count("*").alias("n_gt"))
        np_ = q.groupBy(*g).agg(F.countDistinct("parsed").alias("n_parsed"))
        a = _join_g(a, np_, g)
        a = a.withColumn("GA", _div(F.col("acc_events"), F.col("n_rows"))) \
             .withColumn("PGA", _div(F.col("n_correct"), F.col("n_parsed"))) \
             .withColumn("RGA", _div(F.col("n_correct"), F.col("n_gt")))
    else:
        band_set, band_len = _band_parts(band, g, template_col)
        gb = gt_tab.join(band_set, g + ["gt"], "inner")
        a = gb.groupBy(*g).agg(
            F.sum(F.when(F.col("correct"), F.col("size_g")).otherwise(0)).alias("acc_events"),
            F.sum("size_g").alias("n_rows"),
            F.count_if(F.col("correct")).alias("n_correct"))
        np_ = q.join(band_set, g + ["gt"], "inner").groupBy(*g).agg(F.countDistinct("parsed").alias("n_parsed"))
        a = _join_g(_join_g(a, np_, g), band_len, g)
        a = a.withColumn("GA", _div(F.col("acc_events"), F.col("n_rows"))) \
             .withColumn("PGA", _div(F.col("n_correct"), F.col("n_parsed"))) \
             .withColumn("RGA", _div(F.col("n_correct"), F.col("band_len")))
    return a.withColumn("FGA", _f1(F.col("PGA"), F.col("RGA"))).select(*g, "GA", "PGA", "RGA", "FGA")


def recall_only_grouping(pairs: DataFrame, group_cols=("dataset",)) -> DataFrame:
    """The older scorer seen from the parsed side: GA (same value) and
    its "FGA", which is the recall of groups (named ``rga``)."""
    g = _g(group_cols)
    gt_tab = group_table(pairs, g)
    return gt_tab.groupBy(*g).agg(
        _div(F.sum(F.when(F.col("correct"), F.col("size_g")).otherwise(0)), F.sum("size_g")).alias("ga_parsed_side"),
        _div(F.count_if(F.col("correct")), F.count("*")).alias("rga"))


def wrong_groups(pairs: DataFrame, group_cols=("dataset",)) -> DataFrame:
    """Parsed templates that are not a correct group: the truth
    templates they mix and their row count."""
    g = _g(group_cols)
    q = pairs.filter(F.col("gt").isNotNull())
    ok = group_table(pairs, g).filter("correct").select(*g, "parsed").withColumn("_ok", F.lit(True))
    per_p = q.groupBy(*g, "parsed").agg(F.sort_array(F.collect_list("gt")).alias("truth"),
                                        F.sum("n").alias("rows"))
    return per_p.join(ok, g + ["parsed"], "left").filter(F.col("_ok").isNull()).drop("_ok")


# ---------------------------------------------------------------------------
# Parsing accuracy
# ---------------------------------------------------------------------------

def parsing_accuracy(pairs: DataFrame, band: DataFrame | None = None, group_cols=("dataset",),
                     relaxed: bool = False, template_col: str = "EventTemplate") -> DataFrame:
    """D6 (exact) or D9 (``relaxed``: truth tokens with <*> count as <*>).
    NULL-truth rows count as wrong; with ``band`` only band rows count."""
    g = _g(group_cols)
    p = pairs
    if band is not None:
        band_set, _ = _band_parts(band, g, template_col)
        p = p.join(band_set, g + ["gt"], "inner")
    eq = relaxed_equal(F.col("gt"), F.col("parsed")) if relaxed else \
        F.coalesce(F.col("gt") == F.col("parsed"), F.lit(False))
    return p.groupBy(*g).agg(_div(F.sum(F.when(eq, F.col("n")).otherwise(0)), F.sum("n")).alias("PA"))


# ---------------------------------------------------------------------------
# Template accuracy
# ---------------------------------------------------------------------------

def template_accuracy(pairs: DataFrame, band: DataFrame | None = None, group_cols=("dataset",),
                      relaxed: bool = False, template_col: str = "EventTemplate") -> DataFrame:
    """D7/D8 (and D10 with ``relaxed``): PTA, RTA, FTA and the template
    counts ``tool_templates`` (t1) and ``ground_templates`` (t2)."""
    g = _g(group_cols)
    q = pairs.filter(F.col("gt").isNotNull())
    per_p = q.groupBy(*g, "parsed").agg(F.countDistinct("gt").alias("k"), F.min("gt").alias("gt1"))
    same = relaxed_equal(F.col("parsed"), F.col("gt1")) if relaxed else (F.col("parsed") == F.col("gt1"))
    per_p = per_p.withColumn("ok", (F.col("k") == 1) & same)
    if band is None:
        a = per_p.groupBy(*g).agg(F.count_if("ok").alias("n_correct"), F.count("*").alias("t1"))
        ng = q.groupBy(*g).agg(F.countDistinct("gt").alias("t2"))
        a = _join_g(a, ng, g)
    else:
        band_set, band_len = _band_parts(band, g, template_col)
        touched = q.join(band_set, g + ["gt"], "inner").select(*g, "parsed").distinct() \
            .withColumn("_touch", F.lit(True))
        pb = per_p.join(band_set.withColumnRenamed("gt", "gt1"), g + ["gt1"], "left") \
                  .join(touched, g + ["parsed"], "left")
        pb = pb.withColumn("ok", F.col("ok") & F.coalesce(F.col("_in_band"), F.lit(False)))
        a = pb.groupBy(*g).agg(F.count_if("ok").alias("n_correct"),
                               F.count_if(F.coalesce(F.col("_touch"), F.lit(False))).alias("t1"))
        a = _join_g(a, band_len.withColumnRenamed("band_len", "t2"), g)
    a = a.withColumn("PTA", _div(F.col("n_correct"), F.col("t1"))) \
         .withColumn("RTA", _div(F.col("n_correct"), F.col("t2")))
    return a.withColumn("FTA", _f1(F.col("PTA"), F.col("RTA"))) \
        .select(*g, F.col("t1").alias("tool_templates"),
                F.col("t2").alias("ground_templates"), "PTA", "RTA", "FTA")


# ---------------------------------------------------------------------------
# Similarity accuracy
# ---------------------------------------------------------------------------

def similarity_accuracy(pairs: DataFrame, group_cols=("dataset",)) -> DataFrame:
    """Mean token similarity (G3) of parse and truth over rows."""
    g = _g(group_cols)
    q = pairs.filter(F.col("gt").isNotNull()).withColumn("sim", token_similarity(F.col("gt"), F.col("parsed")))
    return q.groupBy(*g).agg(_div(F.sum(F.col("sim") * F.col("n")), F.sum("n")).alias("SA"))


# ---------------------------------------------------------------------------
# Template classes
# ---------------------------------------------------------------------------

def template_classes(pairs: DataFrame, group_cols=("dataset",)) -> DataFrame:
    """Per parsed template SM (same), OG (more general than every truth
    template it covers), UG (less general), MX (otherwise or mixed).  The
    generality test (C9, G18) only runs on pairs linked by C2."""
    g = _g(group_cols)
    q = pairs.filter(F.col("parsed").isNotNull() & (F.col("parsed") != ""))
    t = q.withColumn("typ", F.when(F.col("gt").isNull(), F.lit("MX"))
                     .when(is_abstract(F.col("parsed"), F.col("gt")), F.lit("OG"))
                     .when(is_abstract(F.col("gt"), F.col("parsed")), F.lit("UG"))
                     .otherwise(F.lit("MX")))
    per = t.groupBy(*g, "parsed").agg(
        F.count("*").alias("k"), F.count("gt").alias("k_nonnull"), F.min("gt").alias("gt1"),
        F.collect_set("typ").alias("types"), F.sum("n").alias("num_messages"),
        F.sort_array(F.collect_list("gt")).alias("corr_oracle_templates"))
    sm = (F.col("k") == 1) & (F.col("k_nonnull") == 1) & (F.col("gt1") == F.col("parsed"))
    typ = F.when(sm, F.lit("SM")).when(F.size("types") == 1, F.col("types")[0]).otherwise(F.lit("MX"))
    return per.select(*g, F.col("parsed").alias("identified_template"), typ.alias("type"),
                      "corr_oracle_templates", "num_messages")


def class_shares(classes: DataFrame, pairs: DataFrame, group_cols=("dataset",)) -> DataFrame:
    """F1, PTA, RTA, OG, UG, MX shares of the parsed templates."""
    g = _g(group_cols)
    a = classes.groupBy(*g).agg(F.count("*").alias("total"),
                                F.count_if(F.col("type") == "SM").alias("sm"),
                                F.count_if(F.col("type") == "OG").alias("og"),
                                F.count_if(F.col("type") == "UG").alias("ug"),
                                F.count_if(F.col("type") == "MX").alias("mx"))
    ng = pairs.filter(F.col("gt").isNotNull()).groupBy(*g).agg(F.countDistinct("gt").alias("n_oracle"))
    a = _join_g(a, ng, g)
    a = a.withColumn("PTA", _div(F.col("sm"), F.col("total"))).withColumn("RTA", _div(F.col("sm"), F.col("n_oracle")))
    return a.select(*g, _f1(F.col("PTA"), F.col("RTA")).alias("F1"), "PTA", "RTA",
                    _div(F.col("og"), F.col("total")).alias("OG"), _div(F.col("ug"), F.col("total")).alias("UG"),
                    _div(F.col("mx"), F.col("total")).alias("MX"))


def corresponding_truth(aligned: DataFrame, line_ids: DataFrame, keys=("dataset", "LineId")) -> DataFrame:
    """The distinct truth templates hit by a set of lines."""
    keys = list(keys)
    return aligned.join(line_ids.select(*keys), keys, "inner").groupBy(*keys[:-1]) \
        .agg(F.array_sort(F.collect_set("gt")).alias("truth_templates"))


# ---------------------------------------------------------------------------
# Whole-row scorers: D28 and the evaluator row
# ---------------------------------------------------------------------------

def evaluate(pairs: DataFrame, band: DataFrame | None = None, group_cols=("dataset",),
             relaxed: bool = False, template_col: str = "EventTemplate") -> DataFrame:
    """One summary row per group: tool_templates, ground_templates, GA, PA,
    FGA, PTA, RTA, FTA.  An empty band gives a row of NULLs (A11)."""
    g = _g(group_cols)
    ga = grouping_accuracy(pairs, band, g, template_col).select(*g, "GA", "FGA")
    pa = parsing_accuracy(pairs, band, g, relaxed, template_col)
    ta = template_accuracy(pairs, band, g, relaxed, template_col)
    keys = pairs.select(*g).distinct() if g else pairs.limit(0).select()
    out = _combine(g, keys, ga, pa, ta) if g else _combine(g, ga, pa, ta)
    if band is not None:
        _, band_len = _band_parts(band, g, template_col)
        out = _combine(g, out, band_len)
        empty = F.coalesce(F.col("band_len"), F.lit(0)) == 0
        out = out.select(*g, *[F.when(~empty, F.col(c)).alias(c) for c in
                               ["tool_templates", "ground_templates"] + METRICS])
    return out.select(*g, "tool_templates", "ground_templates", *METRICS)


def score(pairs: DataFrame, group_cols=("dataset",)) -> DataFrame:
    """The older one-call scorer: GA, FGA (= group recall, D11), PA over
    non-NULL-truth rows, PTA/RTA/FTA and both template counts."""
    g = _g(group_cols)
    q = pairs.filter(F.col("gt").isNotNull())
    rog = recall_only_grouping(pairs, g).select(*g, F.col("ga_parsed_side").alias("GA"), F.col("rga").alias("FGA"))
    pa = parsing_accuracy(q, None, g)
    ta = template_accuracy(pairs, None, g)
    return _combine(g, rog, pa, ta).select(
        *g, "tool_templates", "ground_templates", "GA", "FGA", "PA", "FTA", "PTA", "RTA")


# ---------------------------------------------------------------------------
# Summary table
# ---------------------------------------------------------------------------

def summary_with_average(summary: DataFrame, order_col: str = "load_order", dataset_col: str = "dataset",
                         digits: int = 3) -> DataFrame:
    """B12 + D21 + F3: first row per dataset, then an ``Average`` row with
    the mean of every numeric column rounded to ``digits``."""
    w = Window.partitionBy(dataset_col).orderBy(order_col)
    first = summary.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    numeric = [f.name for f in first.schema.fields
               if f.name not in (dataset_col, order_col) and f.dataType.typeName() in
               ("double", "float", "long", "integer", "decimal")]
    avg = first.agg(*[F.round(F.avg(c), digits).alias(c) for c in numeric]).withColumn(dataset_col, F.lit("Average"))
    body = first.select(dataset_col, *[F.col(c).cast("double").alias(c) for c in numeric])
    return body.unionByName(avg.select(dataset_col, *numeric))


def transpose(summary: DataFrame, dataset_col: str = "dataset", metric_col: str = "metric") -> DataFrame:
    """One row per metric, one column per dataset."""
    metrics = [c for c in summary.columns if c != dataset_col]
    long = summary.unpivot([dataset_col], metrics, metric_col, "value")
    datasets = sorted(r[0] for r in summary.select(dataset_col).distinct().collect())
    return long.groupBy(metric_col).pivot(dataset_col, datasets).agg(F.first("value"))
