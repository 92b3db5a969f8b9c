"""Ground-truth template correction.

Every template of a structured log is rewritten by the oracle-profile rules
(G7); templates that become equal are merged and keep the first of their
EventIds in string order (so ``E10`` sorts before ``E2``, as the reference
does); every line then takes the new id and template through its EventId.
Lines whose EventId is not in the template table are reported instead of
changed.  The template table has one row per template; the id mapping is
made once and written, and the size of its files decides whether it is
broadcast to the lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.text import correct_oracle_template
from logloom.session import cut_lineage


def _g(group_cols):
    return [group_cols] if isinstance(group_cols, str) else list(group_cols)


def template_map(structured: DataFrame, user_strings=None, group_cols=(), order_col: str = "LineId") -> DataFrame:
    """EventId -> (template, corrected, new EventId: the smallest id that becomes the same template).

    The template table is the first line of every distinct template; when one
    EventId carries several templates the later-appearing one is kept.  Lines without an EventId
    (nobody labelled them) make no template."""
    g = _g(group_cols)
    firsts = (structured.filter(F.col("EventTemplate").isNotNull() & F.col("EventId").isNotNull())
              .groupBy(*g, "EventTemplate").agg(F.min_by("EventId", order_col).alias("EventId"),
                                                F.min(order_col).alias("_first")))
    per_id = firsts.groupBy(*g, "EventId").agg(F.max_by("EventTemplate", "_first").alias("EventTemplate"))
    per_id = per_id.withColumn("corrected", correct_oracle_template(F.col("EventTemplate"), user_strings))
    merged = per_id.groupBy(*g, "corrected").agg(F.min("EventId").alias("new_id"))
    return per_id.join(merged, g + ["corrected"])


def correct(structured: DataFrame, user_strings=None, group_cols=(), order_col: str = "LineId"
            ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """P10: returns ``(corrected lines, corrected template table, report of
    lines without a template)``."""
    g = _g(group_cols)
    m = cut_lineage(template_map(structured, user_strings, g, order_col), "template-map")
    j = structured.join(m.select(*g, "EventId", "new_id", "corrected"), g + ["EventId"], "left")
    report = j.filter(F.col("new_id").isNull()).select(*g, order_col, "EventId", *(
        ["Content"] if "Content" in structured.columns else []))
    lines = (j.withColumn("EventId", F.coalesce("new_id", "EventId"))
             .withColumn("EventTemplate", F.when(F.col("new_id").isNotNull(), F.col("corrected"))
                         .otherwise(F.col("EventTemplate")))
             .drop("new_id", "corrected"))
    templates = natural_order(m.select(*g, F.col("new_id").alias("EventId"), F.col("corrected").alias("EventTemplate"))
                              .distinct(), g)
    return lines, templates, report


def natural_order(templates: DataFrame, group_cols=()) -> DataFrame:
    """``pos`` in natural id order (E2 before E10); ids without digits last."""
    from pyspark.sql import Window
    g = _g(group_cols)
    num = F.regexp_extract("EventId", r"\d+", 0)
    key = F.when(num == "", F.lit(None)).otherwise(num.cast("long"))
    w = (Window.partitionBy(*g) if g else Window.partitionBy()).orderBy(key.asc_nulls_last(), F.col("EventId"))
    return templates.withColumn("pos", F.row_number().over(w))


def correction_counts(structured: DataFrame, user_strings=None, group_cols=(), order_col: str = "LineId"
                      ) -> DataFrame:
    """Templates before, after, and changed by correction."""
    g = _g(group_cols)
    m = template_map(structured, user_strings, g, order_col)
    return m.groupBy(*g).agg(F.count("*").alias("n_original"), F.countDistinct("corrected").alias("n_corrected"),
                             F.count_if(F.col("EventTemplate") != F.col("corrected")).alias("n_changed"))
