"""Sequential parse as an as-of match (H3).

Read line by line, a log gives each line the best of the templates born before
it; a line that none of them matches proposes a template, which is born there,
and takes it.  Here the same result comes from three set-at-a-time steps:

1. Every distinct signature is matched against every template that could be
   born (the rule templates of all signatures, one per token path).  Signatures
   with the same rule template and the same matches are one class, and only the
   first line of a class can bear its template: if that line is covered by an
   earlier template, so are all later ones of the class.
2. The births are found in rounds over the classes.  A class is covered once a
   template of its matches is born before it; it bears its own once no template
   of its matches is born before it, and none still could be.  The earliest open
   class is always decided, so the rounds end; their number is the longest chain of
   classes that wait for each other, not the number of lines.
3. The births of a set of matches make a staircase: intervals of lines, each with the
   best template born so far.  Lines join the staircase of their signature by the interval
   their number lies in, and lines before the first step take their own rule template.

The lines are never sorted or gathered by key; the rounds run on a table of the
size of the templates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.text import keyed_signature, propose_template
from logloom.operators.discovery import signatures
from logloom.operators.matching import all_matches, assign_event_ids, prepare_templates
from logloom.session import cut_lineage, ranked


def possible_templates(sigs: DataFrame, group_col: str | None = None, known: DataFrame | None = None) -> DataFrame:
    """pid, template, path, born: one row for each token path that a signature could bear (born NULL),
    and the ``known`` templates (born before all lines)."""
    G = [group_col] if group_col else []
    own = sigs.filter(F.col("rule").isNotNull()).select(*G, "path", F.col("rule").alias("template"), "first_line", F.lit(None).cast("long").alias("born"))
    if known is not None:
        old = known.select(*G, keyed_signature("template", group_col).alias("path"), "template",
                           F.col("template_id").alias("first_line"), F.lit(-1).cast("long").alias("born"))
        own = own.unionByName(old)
    by = F.struct(F.col("born").isNull(), "first_line")  # a known template keeps its path
    own = own.groupBy(*G, "path").agg(F.min_by("template", by).alias("template"), F.min("born").alias("born"), F.min(by).alias("by"))
    return ranked(own.withColumn("first", F.col("by")["first_line"]).withColumn("new", F.col("by")["col1"]).drop("by"),
                  ["new", "first", "path"], "pid", 0).drop("new", "first")


def births(classes: DataFrame, templates: DataFrame) -> DataFrame:
    """pid, born: the templates that come to be, and the line each is born at (-1: known before).

    ``classes``: cid, pid (own template or NULL), first (line), matches (array of pid)."""
    born = cut_lineage(templates.filter(F.col("born").isNotNull()).select("pid", "born"), "births")
    edges = cut_lineage(classes.select("cid", "first", F.explode("matches").alias("pid")), "class-edges")
    pending = cut_lineage(classes.filter(F.col("pid").isNotNull()).select("cid", "pid", "first"), "classes")
    while not pending.isEmpty():
        could = pending.groupBy("pid").agg(F.min("first").alias("could"))
        seen = edges.join(pending.select("cid"), "cid", "left_semi").join(born, "pid", "left").join(could, "pid", "left")
        seen = seen.groupBy("cid").agg(F.max(F.coalesce(F.col("born") < F.col("first"), F.lit(False))).alias("covered"),
                                       F.max(F.coalesce(F.col("could") < F.col("first"), F.lit(False))).alias("waits"))
        state = cut_lineage(pending.join(seen, "cid", "left").withColumn("covered", F.coalesce("covered", F.lit(False)))
                            .withColumn("waits", F.coalesce("waits", F.lit(False))), "class-state")
        free = state.filter(~F.col("covered") & ~F.col("waits")).select("pid", F.col("first").alias("born"))
        born = cut_lineage(born.unionByName(free).groupBy("pid").agg(F.min("born").alias("born")), "births")
        pending = state.filter(~F.col("covered") & F.col("waits")).select("cid", "pid", "first")
    return born


def staircases(sets: DataFrame, born: DataFrame, templates: DataFrame) -> DataFrame:
    """set_id, after, until, template: for lines numbered in (after, until] the best template of the set."""
    rank = F.struct((-F.col("n_static")).alias("a"), F.col("n_wild").alias("b"), F.col("wild_flags").alias("c"), "born")
    steps = (sets.select("set_id", F.explode("matches").alias("pid")).join(born, "pid").join(templates, "pid")
             .select("set_id", "born", F.struct(rank.alias("rank"), "template").alias("step")))
    # known templates are all born at -1: the best of them is the first step
    steps = steps.groupBy("set_id", "born").agg(F.min_by("step", "step.rank").alias("step"))
    so_far = Window.partitionBy("set_id").orderBy("born")  # the births that one message matches
    steps = steps.withColumn("best", F.min_by("step", "step.rank").over(so_far.rowsBetween(Window.unboundedPreceding, 0)))
    steps = steps.filter(F.col("best.rank.born") == F.col("born"))  # only where the best changes
    return steps.select("set_id", F.col("born").alias("after"), F.coalesce(F.lead("born").over(so_far), F.lit((1 << 63) - 1)).alias("until"),
                        F.col("best.template").alias("template"))


def parse_sequential(lines: DataFrame, templates: DataFrame | None = None, content_col: str = "Content",
                     order_col: str = "LineId", group_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(structured, born)``: every line with the template a line-by-line reading gives it
    (``EventTemplate``) and its EventId (E1); and pid, template, born of every template.

    ``templates`` (template_id, template) are known before the first line.  Line numbers are unique
    and not negative.  A token path keeps the text it is born with.  NULL where the rules give
    only a too general template.  Equal ranks go to the template born first."""
    G = [group_col] if group_col else []
    sigs = signatures(lines, content_col, order_col, group_col).withColumn("rule", propose_template(F.col("rep_content")))
    sigs = cut_lineage(sigs.withColumn("path", keyed_signature("rule", group_col)).select(*G, "sig", "first_line", "rule", "path"), "seq-signatures")
    possible = cut_lineage(possible_templates(sigs, group_col, templates), "seq-templates")
    prepared = cut_lineage(prepare_templates(possible, id_col="pid", group_col=group_col), "match-templates")
    found = all_matches(sigs.select("sig"), prepared).groupBy("sig").agg(F.array_sort(F.collect_set("template_id")).alias("matches"))
    none = F.array().cast("array<bigint>")
    sets = (sigs.join(found, "sig", "left").join(possible.select("path", "pid"), "path", "left")
            .select("sig", "first_line", "pid", F.coalesce("matches", none).alias("matches"), F.xxhash64(F.lit(0), F.coalesce("matches", none)).alias("set_id")))
    sets = cut_lineage(sets, "seq-sets")
    classes = sets.groupBy("pid", "set_id").agg(F.min("first_line").alias("first"), F.first("matches").alias("matches"))
    classes = cut_lineage(classes.withColumn("cid", F.monotonically_increasing_id()), "seq-classes")
    born = births(classes, possible)
    ranks = prepared.select(F.col("template_id").alias("pid"), "template", "n_static", "n_wild", "wild_flags")
    stairs = cut_lineage(staircases(classes.select("set_id", "matches").dropDuplicates(["set_id"]), born, ranks), "seq-stairs")

    x = lines.withColumn("_sig", keyed_signature(content_col, group_col))
    x = x.join(sets.select(F.col("sig").alias("_sig"), F.col("set_id").alias("_set")), "_sig", "left")
    steps = stairs.select(F.col("set_id").alias("_s"), F.col("after").alias("_after"), F.col("until").alias("_until"), F.col("template").alias("_t"))
    x = x.join(steps, (F.col("_set") == F.col("_s")) & (F.col(order_col) > F.col("_after")) & (F.col(order_col) <= F.col("_until")), "left")
    out = x.withColumn("EventTemplate", F.when(F.col("_t").isNotNull(), F.col("_t")).otherwise(propose_template(F.col(content_col))))
    out = out.drop("_sig", "_set", "_s", "_after", "_until", "_t")
    return assign_event_ids(out, "EventTemplate", order_col, G), born.join(possible.select(*G, "pid", "template"), "pid")
