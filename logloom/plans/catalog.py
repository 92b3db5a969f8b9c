"""Registered queries over the given tables, with their DuckDB oracles.

Each query takes ``(spark, sf_dir)`` and reads the given Parquet tables (or
tables Spark derives from them).  The log queries read the rendered
``events`` log (``sources.fixtures``); sampling and word statistics read
``documents`` and ``conversations`` texts whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import text as T
from logloom.operators import matching, metrics
from logloom.operators.discovery import parse
from logloom.sources import formats
from logloom.session import spread
from logloom.sources.fixtures import EVENTS_FORMAT, RENDERED_SQL, rendered_events, table

R = f"r AS ({RENDERED_SQL})"


# ---------------------------------------------------------------------------
# parsing
# ---------------------------------------------------------------------------

def _structured(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ev = rendered_events(spark, sf_dir).select("dataset", "LineId", "Content", "gt")
    return parse(ev)


def template_counts(spark, sf_dir):
    """Flagship: parse the whole log, count lines per template (E1 ids)."""
    structured, _ = _structured(spark, sf_dir)
    return matching.template_table(structured).select("EventId", "EventTemplate", "Occurrences")


SQL_TEMPLATE_COUNTS = f"""
WITH {R}, t AS (SELECT expected AS EventTemplate, count(*) AS Occurrences, min(LineId) AS f FROM r GROUP BY expected)
SELECT 'E' || cast(row_number() OVER (ORDER BY f, EventTemplate) AS varchar) AS EventId, EventTemplate, Occurrences FROM t
"""


def event_ids(spark, sf_dir):
    """Structured log: every line with EventId and EventTemplate."""
    structured, _ = _structured(spark, sf_dir)
    return structured.select("LineId", "Content", "EventId", "EventTemplate")


SQL_EVENT_IDS = f"""
WITH {R}, t AS (SELECT expected, min(LineId) AS f FROM r GROUP BY expected),
ids AS (SELECT expected, 'E' || cast(row_number() OVER (ORDER BY f, expected) AS varchar) AS EventId FROM t)
SELECT r.LineId, r.Content, ids.EventId, r.expected AS EventTemplate FROM r JOIN ids USING (expected)
"""


def parse_header(spark, sf_dir):
    """A1 + A2: raw lines -> header columns by the log format."""
    raw = rendered_events(spark, sf_dir).select("LineId", F.col("raw").alias("value"))
    return formats.split_headers(raw, EVENTS_FORMAT).select("LineId", "Date", "Time", "Level", "Component", "Content")


SQL_PARSE_HEADER = f"WITH {R} SELECT LineId, Date, Time, Level, Component, Content FROM r"

_EVENTS_RX = formats.compile_format(EVENTS_FORMAT)[1]


def load_report(spark, sf_dir):
    """A4: loading rate of the rendered log mixed with page URLs (which do
    not fit the format)."""
    raw = rendered_events(spark, sf_dir).select(F.col("raw").alias("value"))
    conv = table(spark, sf_dir, "pages", ["url"]).select(F.col("url").alias("value"))
    return formats.load_report(raw.unionByName(conv), EVENTS_FORMAT)


SQL_LOAD_REPORT = f"""
WITH {R}, lines AS (SELECT raw AS value FROM r UNION ALL SELECT url AS value FROM pages),
s AS (SELECT regexp_matches(regexp_replace(value, '^\\s+|\\s+$', '', 'g'), '{_EVENTS_RX}') AS m FROM lines)
SELECT count(*) AS n_lines, CAST(sum(CASE WHEN m THEN 1 ELSE 0 END) AS BIGINT) AS n_matched,
       round(sum(CASE WHEN m THEN 1.0 ELSE 0.0 END) / count(*), 6) AS loading_rate FROM s
"""


def tokenize(spark, sf_dir):
    """G1 + G26 on messages and their truth templates."""
    ev = rendered_events(spark, sf_dir)
    m = T.tokens(F.col("Content"))
    t = T.tokens(F.col("gt"))
    return ev.select("LineId", F.array_join(m, " ").alias("msg_tokens"), F.size(m).alias("msg_n"),
                     F.array_join(t, " ").alias("tpl_tokens"), T.n_static(t).alias("n_static"),
                     T.n_wild(t).alias("n_wild"))


_TOK_RE = r"""[^\s!"#$%&''()+,\-/:;=?@.\[\\\]^_`{|}~]+|[=|()]"""
SQL_TOKENIZE = f"""
WITH {R}, x AS (SELECT LineId, regexp_extract_all(Content, '{_TOK_RE}') AS m, regexp_extract_all(gt, '{_TOK_RE}') AS t FROM r)
SELECT LineId, array_to_string(m, ' ') AS msg_tokens, len(m) AS msg_n, array_to_string(t, ' ') AS tpl_tokens,
       len(list_filter(t, lambda z: z <> '<*>')) AS n_static, len(list_filter(t, lambda z: z = '<*>')) AS n_wild FROM x
"""


def clean_template(spark, sf_dir):
    """G5 (masks), G8 (full clean-up) and B10 on every message."""
    ev = spread(rendered_events(spark, sf_dir).select("LineId", "Content"))
    return ev.select("LineId", T.mask_variables(F.col("Content")).alias("masked"),
                     T.propose_template(F.col("Content")).alias("template"))


SQL_CLEAN_TEMPLATE = f"""
WITH {R} SELECT LineId,
  CASE WHEN event_type = 'purchase' THEN 'user <*> bought item blk_<*> for <*>.<*> usd from <*>'
       WHEN event_type = 'click' AND LineId % 2 = 1 THEN 'click on button (id=<*>) by user <*> state on'
       WHEN event_type = 'click' THEN 'click on button (id=<*>) by user <*> state off'
       ELSE expected END AS masked,
  expected AS template FROM r
"""


def too_general(spark, sf_dir):
    """B10 + B11 on the truth templates and on their all-wildcard forms."""
    ev = rendered_events(spark, sf_dir)
    t = ev.select(F.col("gt").alias("template")).unionByName(
        ev.select(F.regexp_replace("gt", "[A-Za-z0-9]+", "<*>").alias("template"))).distinct()
    tok = T.tokens(F.col("template"))
    return t.select("template", T.is_too_general(F.col("template")).alias("too_general"),
                    ((F.size(tok) == 0) | (F.array_join(tok, " ") == "<*>")).alias("no_tokens"))


SQL_TOO_GENERAL = f"""
WITH {R}, t AS (SELECT DISTINCT template FROM (SELECT gt AS template FROM r UNION ALL
                 SELECT regexp_replace(gt, '[A-Za-z0-9]+', '<*>', 'g') FROM r))
SELECT template, NOT regexp_matches(replace(template, '<*>', ''), '[^ !-/:-@\\[-`{{-~]') AS too_general,
       len(list_filter(regexp_extract_all(template, '{_TOK_RE}'), lambda z: z <> '<*>')) = 0 AS no_tokens FROM t
"""


def _match_table(ev: DataFrame, drop_type: str | None = None) -> DataFrame:
    keep = ev.filter(F.col("event_type") != "signup")
    if drop_type:
        keep = keep.filter(F.col("event_type") != drop_type)
    t = keep.select(F.col("expected").alias("template")).unionByName(keep.select(F.col("gt").alias("template")))
    t = t.unionByName(ev.limit(1).select(F.lit("<*> session opened").alias("template"))).distinct()
    from pyspark.sql import Window
    w = Window.orderBy("template")  # the template table: a handful of rows
    return t.select(F.row_number().over(w).cast("long").alias("template_id"), "template")


_SQL_MATCH_TABLE = """
tpl AS (SELECT template, row_number() OVER (ORDER BY template) AS template_id FROM (
  SELECT DISTINCT template FROM (
    SELECT expected AS template FROM r WHERE event_type <> 'signup' {extra}
    UNION ALL SELECT gt FROM r WHERE event_type <> 'signup' {extra}
    UNION ALL SELECT '<*> session opened')))
"""


def match_templates(spark, sf_dir):
    """C1 + E2: match every line against a template table (truth, clean-up
    and a leading-wildcard template); the most specific template wins."""
    ev = rendered_events(spark, sf_dir)
    m = matching.match_messages(ev.select("LineId", "Content"), _match_table(ev))
    return m.select("LineId", "template_id", "template")


SQL_MATCH_TEMPLATES = f"""
WITH {R}, {_SQL_MATCH_TABLE.format(extra='')},
w AS (SELECT LineId, CASE WHEN event_type = 'signup' THEN '<*> session opened' ELSE expected END AS template FROM r)
SELECT w.LineId, tpl.template_id, w.template FROM w JOIN tpl USING (template)
"""


def unmatched(spark, sf_dir):
    """Lines no template matches (the view templates are left out)."""
    ev = rendered_events(spark, sf_dir)
    m = matching.match_messages(ev.select("LineId", "Content"), _match_table(ev, "view"))
    return matching.unmatched(m).select("LineId", "Content")


SQL_UNMATCHED = f"WITH {R} SELECT LineId, Content FROM r WHERE event_type = 'view'"


def match_params(spark, sf_dir):
    """The text each wildcard of the winning template takes."""
    ev = rendered_events(spark, sf_dir)
    m = matching.match_messages(spread(ev.select("LineId", "Content")), _match_table(ev), with_params=True)
    return m.select("LineId", F.size("params").alias("n_params"), F.array_join("params", "|").alias("params"))


SQL_MATCH_PARAMS = f"""
WITH {R}, e AS (SELECT LineId, event_type, event_id, user_id, regexp_extract(props, '[0-9]+', 0) AS k,
                 cast(cast(value AS decimal(10,2)) AS varchar) AS v FROM (SELECT *, event_id + 1 AS LineId FROM events))
SELECT LineId,
  CASE WHEN event_type = 'signup' THEN 1 WHEN event_type = 'purchase' THEN 4 ELSE 2 END AS n_params,
  CASE WHEN event_type = 'purchase' THEN cast(user_id AS varchar) || '|blk' || cast(event_id AS varchar) || '|'
            || replace(v, '.', '') || '|100' || cast(user_id % 200 AS varchar) || k
       WHEN event_type = 'click' THEN k || '|' || cast(user_id AS varchar)
       WHEN event_type = 'error' AND event_id % 3 = 0 THEN cast(event_id AS varchar) || '|' || k
       WHEN event_type = 'error' THEN cast(event_id AS varchar) || '|1000' || k
       WHEN event_type = 'view' THEN k || '|200'
       ELSE 'new' END AS params
FROM e
"""


# ---------------------------------------------------------------------------
# scores
# ---------------------------------------------------------------------------

def _pairs(spark, sf_dir, datasets: bool = False) -> DataFrame:
    """D2 for the parse of the rendered log.  The parse keeps the input
    columns, so the truth column travels with each line and no alignment
    join (C2) is needed; ``metrics.align`` is for truth and parse stored
    apart."""
    structured, _ = _structured(spark, sf_dir)
    if datasets:
        structured = structured.withColumn("dataset", F.concat(F.lit("part"), ((F.col("LineId") - 1) % 3).cast("string")))
    aligned = structured.select("dataset", "LineId", "gt", F.coalesce("EventTemplate", F.lit("")).alias("parsed"))
    return metrics.pair_counts(aligned)


def _truth_templates(spark, sf_dir) -> DataFrame:
    ev = rendered_events(spark, sf_dir)
    return ev.groupBy("dataset", F.col("gt").alias("EventTemplate")).agg(F.count("*").alias("Occurrences"))


def _r6(df: DataFrame, cols) -> DataFrame:
    return df.select(*[F.round(F.col(c), 6).alias(c) if c in cols else F.col(c) for c in df.columns])


def grouping_accuracy(spark, sf_dir):
    """D3 + D4: GA, PGA, RGA, FGA of the parse."""
    return _r6(metrics.grouping_accuracy(_pairs(spark, sf_dir)), ["GA", "PGA", "RGA", "FGA"])


_SQL_PAIRS = "p AS (SELECT dataset, gt, expected AS parsed, count(*) AS n FROM r GROUP BY ALL)"
_SQL_GT_TAB = """
q AS (SELECT * FROM p WHERE gt IS NOT NULL),
pg AS (SELECT dataset, gt, sum(n) AS size_g, count(*) AS k, min(parsed) AS parsed FROM q GROUP BY ALL),
pp AS (SELECT dataset, parsed, sum(n) AS size_p FROM q GROUP BY ALL),
gtab AS (SELECT pg.*, (k = 1 AND size_g = size_p) AS correct FROM pg LEFT JOIN pp USING (dataset, parsed))
"""

SQL_GROUPING_ACCURACY = f"""
WITH {R}, {_SQL_PAIRS}, {_SQL_GT_TAB},
a AS (SELECT dataset, sum(CASE WHEN correct THEN size_g ELSE 0 END) * 1.0 / sum(size_g) AS GA,
             sum(CASE WHEN correct THEN 1 ELSE 0 END) * 1.0 / (SELECT count(DISTINCT parsed) FROM q) AS PGA,
             sum(CASE WHEN correct THEN 1 ELSE 0 END) * 1.0 / count(*) AS RGA FROM gtab GROUP BY dataset)
SELECT dataset, round(GA, 6) AS GA, round(PGA, 6) AS PGA, round(RGA, 6) AS RGA,
       round(CASE WHEN PGA + RGA > 0 THEN 2 * PGA * RGA / (PGA + RGA) ELSE 0 END, 6) AS FGA FROM a
"""


def grouping_accuracy_band(spark, sf_dir):
    """D5 + B6: grouping scores restricted to truth templates with 1-4 wildcards."""
    band = metrics.complexity_band(_truth_templates(spark, sf_dir), 2)
    return _r6(metrics.grouping_accuracy(_pairs(spark, sf_dir), band), ["GA", "PGA", "RGA", "FGA"])


_SQL_BAND2 = """band AS (SELECT DISTINCT gt FROM r WHERE
  len(regexp_extract_all(gt, '<\\*>')) BETWEEN 1 AND 4),
blen AS (SELECT count(*) AS band_len FROM (SELECT DISTINCT dataset, gt FROM r) x WHERE gt IN (SELECT gt FROM band))"""

SQL_GROUPING_ACCURACY_BAND = f"""
WITH {R}, {_SQL_PAIRS}, {_SQL_GT_TAB}, {_SQL_BAND2},
a AS (SELECT dataset, sum(CASE WHEN correct THEN size_g ELSE 0 END) * 1.0 / sum(size_g) AS GA,
             sum(CASE WHEN correct THEN 1 ELSE 0 END) * 1.0 /
               (SELECT count(DISTINCT parsed) FROM q WHERE gt IN (SELECT gt FROM band)) AS PGA,
             sum(CASE WHEN correct THEN 1 ELSE 0 END) * 1.0 / (SELECT band_len FROM blen) AS RGA
      FROM gtab WHERE gt IN (SELECT gt FROM band) GROUP BY dataset)
SELECT dataset, round(GA, 6) AS GA, round(PGA, 6) AS PGA, round(RGA, 6) AS RGA,
       round(CASE WHEN PGA + RGA > 0 THEN 2 * PGA * RGA / (PGA + RGA) ELSE 0 END, 6) AS FGA FROM a
"""


def parsing_accuracy(spark, sf_dir):
    """Share of lines whose parsed template equals the truth."""
    return _r6(metrics.parsing_accuracy(_pairs(spark, sf_dir)), ["PA"])


SQL_PARSING_ACCURACY = f"""
WITH {R}, {_SQL_PAIRS}
SELECT dataset, round(sum(CASE WHEN parsed = gt THEN n ELSE 0 END) * 1.0 / sum(n), 6) AS PA FROM p GROUP BY dataset
"""


def parsing_accuracy_relaxed(spark, sf_dir):
    """D9 + G20: PA where truth tokens containing <*> count as <*>."""
    return _r6(metrics.parsing_accuracy(_pairs(spark, sf_dir), relaxed=True), ["PA"])


SQL_PARSING_ACCURACY_RELAXED = f"""
WITH {R}, {_SQL_PAIRS}
SELECT dataset, round(sum(CASE WHEN list_transform(string_split(gt, ' '), lambda z: CASE WHEN contains(z, '<*>') THEN '<*>' ELSE z END)
                            = string_split(parsed, ' ') THEN n ELSE 0 END) * 1.0 / sum(n), 6) AS PA
FROM p GROUP BY dataset
"""


def template_accuracy(spark, sf_dir):
    """PTA, RTA, FTA with both template counts."""
    return _r6(metrics.template_accuracy(_pairs(spark, sf_dir)), ["PTA", "RTA", "FTA"])


_SQL_TA = """
pt AS (SELECT dataset, parsed, count(DISTINCT gt) AS k, min(gt) AS gt1 FROM q GROUP BY ALL),
a AS (SELECT dataset, sum(CASE WHEN {ok} THEN 1 ELSE 0 END) AS c, count(*) AS t1,
             (SELECT count(DISTINCT gt) FROM q) AS t2 FROM pt GROUP BY dataset),
b AS (SELECT dataset, t1, t2, c * 1.0 / t1 AS PTA, c * 1.0 / t2 AS RTA FROM a)
SELECT dataset, t1 AS tool_templates, t2 AS ground_templates, round(PTA, 6) AS PTA, round(RTA, 6) AS RTA,
       round(CASE WHEN PTA + RTA > 0 THEN 2 * PTA * RTA / (PTA + RTA) ELSE 0 END, 6) AS FTA FROM b
"""

SQL_TEMPLATE_ACCURACY = f"""
WITH {R}, {_SQL_PAIRS}, q AS (SELECT * FROM p WHERE gt IS NOT NULL),
{_SQL_TA.format(ok="k = 1 AND parsed = gt1")}
"""


def template_accuracy_relaxed(spark, sf_dir):
    """Template scores with the parsed side relaxed."""
    return _r6(metrics.template_accuracy(_pairs(spark, sf_dir), relaxed=True), ["PTA", "RTA", "FTA"])


SQL_TEMPLATE_ACCURACY_RELAXED = f"""
WITH {R}, {_SQL_PAIRS}, q AS (SELECT * FROM p WHERE gt IS NOT NULL),
{_SQL_TA.format(ok="k = 1 AND list_transform(string_split(parsed, ' '), lambda z: CASE WHEN contains(z, '<*>') THEN '<*>' ELSE z END) = string_split(gt1, ' ')")}
"""


def template_accuracy_band(spark, sf_dir):
    """D8 + B7: template scores on the least frequent half of the truth templates."""
    band = metrics.frequency_band(_truth_templates(spark, sf_dir), 50, ["dataset"])
    return _r6(metrics.template_accuracy(_pairs(spark, sf_dir), band), ["PTA", "RTA", "FTA"])


SQL_TEMPLATE_ACCURACY_BAND = f"""
WITH {R}, {_SQL_PAIRS}, q AS (SELECT * FROM p WHERE gt IS NOT NULL),
tt AS (SELECT gt, count(*) AS occ FROM r GROUP BY gt),
ranked AS (SELECT gt, row_number() OVER (ORDER BY occ, gt) AS pos, count(*) OVER () AS cnt FROM tt),
band AS (SELECT gt FROM ranked WHERE pos <= floor(cnt / 100.0 * 50)),
pt AS (SELECT dataset, parsed, count(DISTINCT gt) AS k, min(gt) AS gt1,
              max(CASE WHEN gt IN (SELECT gt FROM band) THEN 1 ELSE 0 END) AS touch FROM q GROUP BY ALL),
a AS (SELECT dataset, sum(CASE WHEN k = 1 AND parsed = gt1 AND gt1 IN (SELECT gt FROM band) THEN 1 ELSE 0 END) AS c,
             CAST(sum(touch) AS BIGINT) AS t1, (SELECT count(*) FROM band) AS t2 FROM pt GROUP BY dataset),
b AS (SELECT dataset, t1, t2, c * 1.0 / t1 AS PTA, c * 1.0 / t2 AS RTA FROM a)
SELECT dataset, t1 AS tool_templates, t2 AS ground_templates, round(PTA, 6) AS PTA, round(RTA, 6) AS RTA,
       round(CASE WHEN PTA + RTA > 0 THEN 2 * PTA * RTA / (PTA + RTA) ELSE 0 END, 6) AS FTA FROM b
"""


def recall_only_grouping(spark, sf_dir):
    """Older GA (parsed side) and group recall."""
    return _r6(metrics.recall_only_grouping(_pairs(spark, sf_dir)), ["ga_parsed_side", "rga"])


SQL_RECALL_ONLY_GROUPING = f"""
WITH {R}, {_SQL_PAIRS}, {_SQL_GT_TAB}
SELECT dataset, round(sum(CASE WHEN correct THEN size_g ELSE 0 END) * 1.0 / sum(size_g), 6) AS ga_parsed_side,
       round(sum(CASE WHEN correct THEN 1 ELSE 0 END) * 1.0 / count(*), 6) AS rga FROM gtab GROUP BY dataset
"""


def wrong_groups(spark, sf_dir):
    """Parsed templates that mix or split truth groups."""
    w = metrics.wrong_groups(_pairs(spark, sf_dir))
    return w.select("dataset", "parsed", F.array_join("truth", " || ").alias("truth"), "rows")


SQL_WRONG_GROUPS = f"""
WITH {R}, {_SQL_PAIRS}, {_SQL_GT_TAB},
pt AS (SELECT dataset, parsed, array_to_string(list_sort(list(gt)), ' || ') AS truth, CAST(sum(n) AS BIGINT) AS "rows" FROM q GROUP BY ALL)
SELECT pt.* FROM pt WHERE parsed NOT IN (SELECT parsed FROM gtab WHERE correct)
"""


def score_all(spark, sf_dir):
    """The one-call scorer row."""
    s = metrics.score(_pairs(spark, sf_dir))
    return _r6(s, ["GA", "FGA", "PA", "FTA", "PTA", "RTA"])


SQL_SCORE_ALL = f"""
WITH {R}, {_SQL_PAIRS}, {_SQL_GT_TAB},
g AS (SELECT dataset, sum(CASE WHEN correct THEN size_g ELSE 0 END) * 1.0 / sum(size_g) AS GA,
             sum(CASE WHEN correct THEN 1 ELSE 0 END) * 1.0 / count(*) AS FGA FROM gtab GROUP BY dataset),
pa AS (SELECT dataset, sum(CASE WHEN parsed = gt THEN n ELSE 0 END) * 1.0 / sum(n) AS PA FROM q GROUP BY dataset),
pt AS (SELECT dataset, parsed, count(DISTINCT gt) AS k, min(gt) AS gt1 FROM q GROUP BY ALL),
a AS (SELECT dataset, sum(CASE WHEN k = 1 AND parsed = gt1 THEN 1 ELSE 0 END) AS c, count(*) AS t1,
             (SELECT count(DISTINCT gt) FROM q) AS t2 FROM pt GROUP BY dataset),
b AS (SELECT dataset, t1, t2, c * 1.0 / t1 AS PTA, c * 1.0 / t2 AS RTA FROM a)
SELECT b.dataset, t1 AS tool_templates, t2 AS ground_templates, round(GA, 6) AS GA, round(FGA, 6) AS FGA,
       round(PA, 6) AS PA, round(CASE WHEN PTA + RTA > 0 THEN 2 * PTA * RTA / (PTA + RTA) ELSE 0 END, 6) AS FTA,
       round(PTA, 6) AS PTA, round(RTA, 6) AS RTA
FROM b JOIN g USING (dataset) JOIN pa USING (dataset)
"""


def similarity_accuracy(spark, sf_dir):
    """D27 + G2 + G3: mean token similarity of parse and truth."""
    return _r6(metrics.similarity_accuracy(_pairs(spark, sf_dir)), ["SA"])


_STOK = r"""[^\s!"#$%&''()+,\-/:;=?@.\[\\\]^_`{|}~]+|[\s!"#$%&''()+,\-/:;=?@.\[\\\]^_`{|}~]+"""
_SQL_STOK = ("list_filter(list_transform(regexp_extract_all({c}, '" + _STOK + "'), lambda z: "
             "CASE WHEN contains(z, '<*>') THEN '<*>' ELSE regexp_replace(z, '[\\s!\"#$%&''+,\\-/:;?@.\\[\\\\\\]^_`{}~]', '', 'g') END),"
             " lambda z: z <> '')")
SQL_SIMILARITY_ACCURACY = f"""
WITH {R}, {_SQL_PAIRS},
t AS (SELECT dataset, n, {_SQL_STOK.replace('{c}', 'gt')} AS a, {_SQL_STOK.replace('{c}', 'parsed')} AS b FROM p WHERE gt IS NOT NULL),
s AS (SELECT dataset, n, len(list_intersect(list_distinct(a), list_distinct(b))) AS i, len(a) AS la, len(b) AS lb FROM t)
SELECT dataset, round(sum(n * (i * 1.0 / (la + lb - i))) / sum(n), 6) AS SA FROM s GROUP BY dataset
"""


def template_classes(spark, sf_dir):
    """D13 + C9 + G17 + G18: SM / OG / UG / MX per parsed template."""
    c = metrics.template_classes(_pairs(spark, sf_dir))
    return c.select("dataset", "identified_template", "type", "num_messages")


SQL_TEMPLATE_CLASSES = f"""
WITH {R}, {_SQL_PAIRS},
t AS (SELECT dataset, parsed, gt, n,
        CASE WHEN regexp_full_match(gt, regexp_replace(regexp_replace(regexp_replace(parsed, '([\\\\^$.|?*+()\\[\\]{{}}])', '\\\\\\1', 'g'), '\\s', '\\\\s+', 'g'), '<\\\\\\*>', '(\\\\S+?)', 'g')) THEN 'OG'
             WHEN regexp_full_match(parsed, regexp_replace(regexp_replace(regexp_replace(gt, '([\\\\^$.|?*+()\\[\\]{{}}])', '\\\\\\1', 'g'), '\\s', '\\\\s+', 'g'), '<\\\\\\*>', '(\\\\S+?)', 'g')) THEN 'UG'
             ELSE 'MX' END AS typ FROM p),
c AS (SELECT dataset, parsed, count(*) AS k, min(gt) AS gt1, count(DISTINCT typ) AS nt, min(typ) AS typ1, CAST(sum(n) AS BIGINT) AS num_messages
      FROM t GROUP BY ALL)
SELECT dataset, parsed AS identified_template,
       CASE WHEN k = 1 AND gt1 = parsed THEN 'SM' WHEN nt = 1 THEN typ1 ELSE 'MX' END AS type, num_messages FROM c
"""


def class_shares(spark, sf_dir):
    """Shares of the template classes."""
    pairs = _pairs(spark, sf_dir)
    s = metrics.class_shares(metrics.template_classes(pairs), pairs)
    return _r6(s, ["F1", "PTA", "RTA", "OG", "UG", "MX"])


SQL_CLASS_SHARES = f"""
WITH c AS ({SQL_TEMPLATE_CLASSES}), {R},
a AS (SELECT dataset, count(*) AS total, sum(CASE WHEN type = 'SM' THEN 1 ELSE 0 END) AS sm,
             sum(CASE WHEN type = 'OG' THEN 1 ELSE 0 END) AS og, sum(CASE WHEN type = 'UG' THEN 1 ELSE 0 END) AS ug,
             sum(CASE WHEN type = 'MX' THEN 1 ELSE 0 END) AS mx, (SELECT count(DISTINCT gt) FROM r) AS n_oracle
      FROM c GROUP BY dataset),
b AS (SELECT *, sm * 1.0 / total AS PTA, sm * 1.0 / n_oracle AS RTA FROM a)
SELECT dataset, round(CASE WHEN PTA + RTA > 0 THEN 2 * PTA * RTA / (PTA + RTA) ELSE 0 END, 6) AS F1,
       round(PTA, 6) AS PTA, round(RTA, 6) AS RTA, round(og * 1.0 / total, 6) AS OG,
       round(ug * 1.0 / total, 6) AS UG, round(mx * 1.0 / total, 6) AS MX FROM b
"""


def score_by_dataset(spark, sf_dir):
    """P8 + A11: the evaluator row for three datasets in one job."""
    e = metrics.evaluate(_pairs(spark, sf_dir, datasets=True))
    return _r6(e, metrics.METRICS)


_SQL_DS = """d AS (SELECT 'part' || cast((LineId - 1) % 3 AS varchar) AS dataset, gt, expected FROM r),
p AS (SELECT dataset, gt, expected AS parsed, count(*) AS n FROM d GROUP BY ALL)"""
SQL_SCORE_BY_DATASET = f"""
WITH {R}, {_SQL_DS}, {_SQL_GT_TAB},
np AS (SELECT dataset, count(DISTINCT parsed) AS n_parsed, count(DISTINCT gt) AS n_gt FROM q GROUP BY dataset),
g AS (SELECT dataset, sum(CASE WHEN correct THEN size_g ELSE 0 END) * 1.0 / sum(size_g) AS GA,
             sum(CASE WHEN correct THEN 1 ELSE 0 END) AS nc FROM gtab GROUP BY dataset),
g2 AS (SELECT g.dataset, GA, nc * 1.0 / n_parsed AS PGA, nc * 1.0 / n_gt AS RGA FROM g JOIN np USING (dataset)),
pa AS (SELECT dataset, sum(CASE WHEN parsed = gt THEN n ELSE 0 END) * 1.0 / sum(n) AS PA FROM p GROUP BY dataset),
pt AS (SELECT dataset, parsed, count(DISTINCT gt) AS k, min(gt) AS gt1 FROM q GROUP BY ALL),
a AS (SELECT pt.dataset, sum(CASE WHEN k = 1 AND parsed = gt1 THEN 1 ELSE 0 END) AS c, count(*) AS t1, min(n_gt) AS t2
      FROM pt JOIN np USING (dataset) GROUP BY pt.dataset),
b AS (SELECT dataset, t1, t2, c * 1.0 / t1 AS PTA, c * 1.0 / t2 AS RTA FROM a)
SELECT b.dataset, t1 AS tool_templates, t2 AS ground_templates, round(GA, 6) AS GA, round(PA, 6) AS PA,
       round(CASE WHEN PGA + RGA > 0 THEN 2 * PGA * RGA / (PGA + RGA) ELSE 0 END, 6) AS FGA,
       round(PTA, 6) AS PTA, round(RTA, 6) AS RTA,
       round(CASE WHEN PTA + RTA > 0 THEN 2 * PTA * RTA / (PTA + RTA) ELSE 0 END, 6) AS FTA
FROM b JOIN g2 USING (dataset) JOIN pa USING (dataset)
"""


def score_band_empty(spark, sf_dir):
    """A11 + B6: a band with no templates (five or more wildcards) gives a
    row of NULLs."""
    band = metrics.complexity_band(_truth_templates(spark, sf_dir), 3)
    e = metrics.evaluate(_pairs(spark, sf_dir), band)
    return e


SQL_SCORE_BAND_EMPTY = f"""
WITH {R} SELECT DISTINCT dataset, CAST(NULL AS BIGINT) AS tool_templates, CAST(NULL AS BIGINT) AS ground_templates,
  CAST(NULL AS DOUBLE) AS GA, CAST(NULL AS DOUBLE) AS PA, CAST(NULL AS DOUBLE) AS FGA,
  CAST(NULL AS DOUBLE) AS PTA, CAST(NULL AS DOUBLE) AS RTA, CAST(NULL AS DOUBLE) AS FTA FROM r
"""


def summary_average(spark, sf_dir):
    """B12 + B14 + D21 + F3: per-dataset rows (first per dataset) plus the Average row."""
    e = metrics.evaluate(_pairs(spark, sf_dir, datasets=True))
    e = e.select("dataset", *[F.round(c, 3).alias(c) for c in metrics.METRICS]).withColumn("load_order", F.lit(1))
    return metrics.summary_with_average(e)


SQL_SUMMARY_AVERAGE = f"""
WITH s AS ({SQL_SCORE_BY_DATASET}),
s3 AS (SELECT dataset, round(GA, 3) AS GA, round(PA, 3) AS PA, round(FGA, 3) AS FGA, round(PTA, 3) AS PTA,
              round(RTA, 3) AS RTA, round(FTA, 3) AS FTA FROM s)
SELECT * FROM s3 UNION ALL
SELECT 'Average', round(avg(GA), 3), round(avg(PA), 3), round(avg(FGA), 3), round(avg(PTA), 3), round(avg(RTA), 3),
       round(avg(FTA), 3) FROM s3
"""


def summary_transposed(spark, sf_dir):
    """The summary with one row per metric and one column per dataset."""
    return metrics.transpose(summary_average(spark, sf_dir))


SQL_SUMMARY_TRANSPOSED = f"""
WITH a AS ({SQL_SUMMARY_AVERAGE}),
l AS (UNPIVOT a ON GA, PA, FGA, PTA, RTA, FTA INTO NAME metric VALUE value)
SELECT metric, max(CASE WHEN dataset = 'Average' THEN value END) AS "Average",
       max(CASE WHEN dataset = 'part0' THEN value END) AS part0, max(CASE WHEN dataset = 'part1' THEN value END) AS part1,
       max(CASE WHEN dataset = 'part2' THEN value END) AS part2 FROM l GROUP BY metric
"""


QUERIES = {
    "template_counts": (template_counts, SQL_TEMPLATE_COUNTS),
    "event_ids": (event_ids, SQL_EVENT_IDS),
    "parse_header": (parse_header, SQL_PARSE_HEADER),
    "load_report": (load_report, SQL_LOAD_REPORT),
    "tokenize": (tokenize, SQL_TOKENIZE),
    "clean_template": (clean_template, SQL_CLEAN_TEMPLATE),
    "too_general": (too_general, SQL_TOO_GENERAL),
    "match_templates": (match_templates, SQL_MATCH_TEMPLATES),
    "unmatched": (unmatched, SQL_UNMATCHED),
    "match_params": (match_params, SQL_MATCH_PARAMS),
    "grouping_accuracy": (grouping_accuracy, SQL_GROUPING_ACCURACY),
    "grouping_accuracy_band": (grouping_accuracy_band, SQL_GROUPING_ACCURACY_BAND),
    "parsing_accuracy": (parsing_accuracy, SQL_PARSING_ACCURACY),
    "parsing_accuracy_relaxed": (parsing_accuracy_relaxed, SQL_PARSING_ACCURACY_RELAXED),
    "template_accuracy": (template_accuracy, SQL_TEMPLATE_ACCURACY),
    "template_accuracy_relaxed": (template_accuracy_relaxed, SQL_TEMPLATE_ACCURACY_RELAXED),
    "template_accuracy_band": (template_accuracy_band, SQL_TEMPLATE_ACCURACY_BAND),
    "recall_only_grouping": (recall_only_grouping, SQL_RECALL_ONLY_GROUPING),
    "wrong_groups": (wrong_groups, SQL_WRONG_GROUPS),
    "score_all": (score_all, SQL_SCORE_ALL),
    "similarity_accuracy": (similarity_accuracy, SQL_SIMILARITY_ACCURACY),
    "template_classes": (template_classes, SQL_TEMPLATE_CLASSES),
    "class_shares": (class_shares, SQL_CLASS_SHARES),
    "score_by_dataset": (score_by_dataset, SQL_SCORE_BY_DATASET),
    "score_band_empty": (score_band_empty, SQL_SCORE_BAND_EMPTY),
    "summary_average": (summary_average, SQL_SUMMARY_AVERAGE),
    "summary_transposed": (summary_transposed, SQL_SUMMARY_TRANSPOSED),
}


# ---------------------------------------------------------------------------
# sampling (documents, whole texts; label = source)
# ---------------------------------------------------------------------------

def _labelled_docs(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents", ["doc_id", "text", "source"])
    return d.select((F.col("doc_id") + 1).alias("row_id"), F.col("text").alias("Content"),
                    F.col("source").alias("EventTemplate"))


def _clustered(spark, sf_dir):
    from logloom.operators import sampling
    return sampling.clusters(sampling.prepare(_labelled_docs(spark, sf_dir)))


def vocab_counts(spark, sf_dir):
    """D15 + G9 + G28 + B4: vocabulary counts over all documents."""
    from logloom.operators import sampling
    return sampling.vocabulary(sampling.prepare(_labelled_docs(spark, sf_dir)))


_SQL_STOP = ", ".join("'" + w + "'" for w in T.SAMPLER_STOPWORDS)
_SQL_DOCS = f"""
d AS (SELECT doc_id + 1 AS row_id, text, source FROM documents),
c AS (SELECT row_id, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(text, '[:()=,"{{}}@\\[\\]|;]|\\.?!', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), '\\s+'),
                                 lambda w: w <> '' AND NOT regexp_matches(w, '[0-9]')) AS ws FROM d),
k AS (SELECT * FROM c WHERE len(ws) > 1),
vw AS (SELECT row_id, unnest(ws) AS token FROM k),
vocab AS (SELECT token, count(*) AS cnt FROM vw WHERE length(token) > 2 AND token NOT IN ({_SQL_STOP}) GROUP BY token)
"""

SQL_VOCAB_COUNTS = f"WITH {_SQL_DOCS} SELECT token, cnt FROM vocab"


def top3_tokens(spark, sf_dir):
    """Per document the three most frequent words (sorted) = coarse key."""
    return _clustered(spark, sf_dir).select("row_id", "coarse")


_SQL_TOP3 = """
dt AS (SELECT DISTINCT row_id, token FROM vw WHERE length(token) > 2 AND token IN (SELECT token FROM vocab)),
rk AS (SELECT dt.row_id, dt.token, row_number() OVER (PARTITION BY dt.row_id ORDER BY v.cnt DESC, dt.token) AS rn
       FROM dt JOIN vocab v USING (token)),
top AS (SELECT row_id, array_to_string(list_sort(list(token)), ' ') AS coarse FROM rk WHERE rn <= 3 GROUP BY row_id),
cl AS (SELECT k.row_id, coalesce(top.coarse, '') AS coarse FROM k LEFT JOIN top USING (row_id))
"""
SQL_TOP3_TOKENS = f"WITH {_SQL_DOCS}, {_SQL_TOP3} SELECT row_id, coarse FROM cl"


def signature_clusters(spark, sf_dir):
    """G9 + D16 + D17: rows per (coarse, fine) cluster and per coarse cluster."""
    from logloom.operators import sampling
    cl = _clustered(spark, sf_dir)
    f = sampling.fine_sizes(cl)
    c = sampling.coarse_sizes(cl).withColumnRenamed("size", "coarse_size")
    return f.join(c, "coarse").select("coarse", "fine", "size", "coarse_size")


_SQL_FINE = """
fi AS (SELECT d.row_id, array_to_string(list_sort(list_distinct(list_filter(string_split(regexp_replace(text, '[0-9A-Za-z, ]+', '', 'g'), ''), lambda z: z <> ''))), '') AS fine FROM d),
cf AS (SELECT cl.row_id, cl.coarse, fi.fine FROM cl JOIN fi USING (row_id)),
fs AS (SELECT coarse, fine, count(*) AS size FROM cf GROUP BY ALL),
cs AS (SELECT coarse, count(*) AS coarse_size, count(DISTINCT fine) AS n_fine FROM cf GROUP BY coarse)
"""
SQL_SIGNATURE_CLUSTERS = f"""WITH {_SQL_DOCS}, {_SQL_TOP3}, {_SQL_FINE}
SELECT fs.coarse, fs.fine, fs.size, cs.coarse_size FROM fs JOIN cs USING (coarse)"""


def cluster_totals(spark, sf_dir):
    """Number of coarse and fine clusters."""
    from logloom.operators import sampling
    return sampling.cluster_totals(_clustered(spark, sf_dir))


SQL_CLUSTER_TOTALS = f"""WITH {_SQL_DOCS}, {_SQL_TOP3}, {_SQL_FINE}
SELECT count(DISTINCT coarse) AS n_coarse, count(*) AS n_fine FROM fs"""


def quota_allocation(spark, sf_dir):
    """E5 + E6 + P9: quotas per shot over coarse (key order) and fine clusters."""
    from logloom.operators import sampling
    q = sampling.quotas(_clustered(spark, sf_dir), order="key")
    return q.select("shot", "coarse", "fine", "c_pos", "f_pos", "c_quota", "quota")


SQL_QUOTA_ALLOCATION = f"""WITH {_SQL_DOCS}, {_SQL_TOP3}, {_SQL_FINE},
nc AS (SELECT count(*) AS c FROM cs),
cp AS (SELECT coarse, n_fine, row_number() OVER (ORDER BY coarse) - 1 AS c_pos FROM cs),
sh AS (SELECT unnest([8, 16, 32, 64, 128]) AS shot),
cq AS (SELECT shot, coarse, n_fine, c_pos, CAST(floor(shot / c) + CASE WHEN c_pos < shot % c THEN 1 ELSE 0 END AS INTEGER) AS c_quota
       FROM cp, sh, nc),
fp AS (SELECT coarse, fine, row_number() OVER (PARTITION BY coarse ORDER BY size DESC, fine) - 1 AS f_pos FROM fs),
j AS (SELECT cq.shot, cq.coarse, fp.fine, cq.c_pos, fp.f_pos, cq.c_quota,
             CAST(floor(c_quota / n_fine) + CASE WHEN f_pos < c_quota % n_fine THEN 1 ELSE 0 END AS INTEGER) AS quota
      FROM cq JOIN fp USING (coarse) WHERE cq.c_quota > 0)
SELECT shot, coarse, fine, CAST(c_pos AS INTEGER) AS c_pos, CAST(f_pos AS INTEGER) AS f_pos, c_quota, quota FROM j WHERE quota > 0
"""


# ---------------------------------------------------------------------------
# examples and prompts (conversation texts against benchmark items)
# ---------------------------------------------------------------------------

def _queries_examples(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations", ["conv_id", "turn", "text"])
    q = conv.select((F.col("conv_id") * 1048576 + F.col("turn")).alias("qid"), F.col("text").alias("query_text"))
    b = table(spark, sf_dir, "benchmark", ["item_id", "text"])
    ex = b.select(F.col("item_id").alias("pos"), F.col("text").alias("query"), F.col("text").alias("answer"))
    return q, ex


def nearest_examples(spark, sf_dir):
    """C5 + E4 + G13: the three nearest benchmark items of every conversation
    turn by word-multiset Jaccard distance."""
    from logloom.operators.examples import nearest_pairs
    q, ex = _queries_examples(spark, sf_dir)
    r = nearest_pairs(q, ex, k=3)
    return r.select("qid", F.col("rank").cast("int").alias("rank"), "pos", F.round("dist", 6).alias("dist"))


_SQL_QE = """
q AS (SELECT conv_id * 1048576 + turn AS qid, text AS qt FROM conversations),
ex AS (SELECT item_id AS pos, text AS et FROM benchmark),
qw AS (SELECT qid, w, count(*) AS c FROM (SELECT qid, unnest(regexp_split_to_array(regexp_replace(qt, '^\\s+|\\s+$', '', 'g'), '\\s+')) AS w FROM q) WHERE w <> '' GROUP BY ALL),
ew AS (SELECT pos, w, count(*) AS c FROM (SELECT pos, unnest(regexp_split_to_array(regexp_replace(et, '^\\s+|\\s+$', '', 'g'), '\\s+')) AS w FROM ex) WHERE w <> '' GROUP BY ALL),
ql AS (SELECT q.qid, coalesce(sum(c), 0) AS l FROM q LEFT JOIN qw USING (qid) GROUP BY q.qid),
el AS (SELECT ex.pos, coalesce(sum(c), 0) AS l FROM ex LEFT JOIN ew USING (pos) GROUP BY ex.pos),
inter AS (SELECT qw.qid, ew.pos, sum(least(qw.c, ew.c)) AS i FROM qw JOIN ew USING (w) GROUP BY ALL),
pairs AS (SELECT ql.qid, el.pos, coalesce(i, 0) AS i, ql.l AS lq, el.l AS le FROM ql CROSS JOIN el
          LEFT JOIN inter ON inter.qid = ql.qid AND inter.pos = el.pos),
dist AS (SELECT qid, pos, CASE WHEN lq + le - i = 0 THEN 0.0 ELSE 1.0 - i * 1.0 / (lq + le - i) END AS dist FROM pairs),
rk AS (SELECT qid, pos, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, pos) AS rank FROM dist)
"""
SQL_NEAREST_EXAMPLES = f"WITH {_SQL_QE} SELECT qid, CAST(rank AS INTEGER) AS rank, pos, round(dist, 6) AS dist FROM rk WHERE rank <= 3"


def example_distances(spark, sf_dir):
    """Cosine (character count) distance of each turn to its nearest
    benchmark item.  (Levenshtein, G14, is checked against brute force in
    tests: DuckDB's levenshtein counts bytes, not characters.)"""
    from logloom.functions.distance import cosine_distance
    from logloom.operators.examples import nearest_pairs
    q, ex = _queries_examples(spark, sf_dir)
    top = nearest_pairs(q, ex, k=1).join(q, "qid").join(ex, "pos")
    return top.select("qid", "pos", F.round(cosine_distance("query_text", "query"), 6).alias("cos"))


SQL_EXAMPLE_DISTANCES = f"""WITH {_SQL_QE},
t AS (SELECT rk.qid, rk.pos, q.qt, ex.et FROM rk JOIN q USING (qid) JOIN ex USING (pos) WHERE rank = 1),
qc AS (SELECT qid, ch, count(*) AS c FROM (SELECT qid, unnest(string_split(qt, '')) AS ch FROM t) WHERE ch <> '' GROUP BY ALL),
ec AS (SELECT qid, ch, count(*) AS c FROM (SELECT qid, unnest(string_split(et, '')) AS ch FROM t) WHERE ch <> '' GROUP BY ALL),
ci AS (SELECT qc.qid, sum(least(qc.c, ec.c)) AS i FROM qc JOIN ec USING (qid, ch) GROUP BY qc.qid)
SELECT t.qid, t.pos,
  round(CASE WHEN qt = et THEN 0.0 WHEN length(qt) * length(et) = 0 THEN 1.0
             ELSE 1.0 - coalesce(ci.i, 0) / sqrt(length(qt) * 1.0 * length(et)) END, 6) AS cos
FROM t LEFT JOIN ci USING (qid)
"""


def random_examples(spark, sf_dir):
    """Three hashed draws with replacement per turn."""
    from logloom.operators.examples import random_examples as rnd
    q, ex = _queries_examples(spark, sf_dir)
    return rnd(q, ex, k=3).select("qid", "draw", "pos")


SQL_RANDOM_EXAMPLES = """
WITH q AS (SELECT conv_id * 1048576 + turn AS qid FROM conversations),
e AS (SELECT item_id AS pos, row_number() OVER (ORDER BY item_id) - 1 AS i FROM benchmark),
d AS (SELECT qid, unnest([1, 2, 3]) AS draw FROM q)
SELECT d.qid, CAST(d.draw AS INTEGER) AS draw, e.pos FROM d JOIN e
  ON ('0x' || substr(md5('0:' || d.qid || ':' || d.draw), 1, 15))::BIGINT % (SELECT count(*) FROM benchmark) = e.i
"""


def build_prompts(spark, sf_dir):
    """G22 + G23 + G24: chat prompts with the three nearest items as examples."""
    from logloom.operators.discovery import build_prompt
    from logloom.operators.examples import nearest_examples as near
    q, ex = _queries_examples(spark, sf_dir)
    n = near(q, ex, k=3)
    p = q.join(n, "qid", "left").withColumn("messages", build_prompt(F.col("query_text"), F.col("examples")))
    return p.select("qid", F.size("messages").alias("n_messages"),
                    F.element_at("messages", -1)["content"].alias("question"),
                    F.element_at("messages", 4)["content"].alias("first_example"))


SQL_BUILD_PROMPTS = f"""WITH {_SQL_QE}
SELECT q.qid, 10 AS n_messages, 'Log message: `' || q.qt || '`' AS question,
       'Log message: `' || ex.et || '`' AS first_example
FROM q JOIN rk USING (qid) JOIN ex USING (pos) WHERE rk.rank = 1
"""


def parse_answers(spark, sf_dir):
    """Template text out of model-style answers built from the truth."""
    ev = rendered_events(spark, sf_dir)
    resp = (F.when(F.col("LineId") % 4 == 0, F.concat(F.lit("Sure.\nLog template: `"), F.col("gt"), F.lit("`\nDone")))
            .when(F.col("LineId") % 4 == 1, F.concat(F.lit("The template is `"), F.col("gt"), F.lit("` here")))
            .when(F.col("LineId") % 4 == 2, F.concat(F.lit('Log template: "'), F.col("gt"), F.lit('"')))
            .otherwise(F.concat(F.lit("no template for "), F.col("Content"))))
    return ev.select("LineId", T.parse_answer(resp).alias("template"))


SQL_PARSE_ANSWERS = f"""WITH {R}
SELECT LineId, CASE WHEN LineId % 4 = 3 THEN NULL ELSE gt END AS template FROM r
"""

QUERIES.update({
    "vocab_counts": (vocab_counts, SQL_VOCAB_COUNTS),
    "top3_tokens": (top3_tokens, SQL_TOP3_TOKENS),
    "signature_clusters": (signature_clusters, SQL_SIGNATURE_CLUSTERS),
    "cluster_totals": (cluster_totals, SQL_CLUSTER_TOTALS),
    "quota_allocation": (quota_allocation, SQL_QUOTA_ALLOCATION),
    "nearest_examples": (nearest_examples, SQL_NEAREST_EXAMPLES),
    "example_distances": (example_distances, SQL_EXAMPLE_DISTANCES),
    "random_examples": (random_examples, SQL_RANDOM_EXAMPLES),
    "build_prompts": (build_prompts, SQL_BUILD_PROMPTS),
    "parse_answers": (parse_answers, SQL_PARSE_ANSWERS),
})


# ---------------------------------------------------------------------------
# correction (G7 D22 C4 D23 E9 P10) on a truth log whose error and view
# templates are the raw messages
# ---------------------------------------------------------------------------

def _raw_truth(spark, sf_dir) -> DataFrame:
    ev = rendered_events(spark, sf_dir)
    t = F.when(F.col("event_type").isin("error", "view"), F.col("Content")).otherwise(F.col("gt"))
    s = ev.select("LineId", "Content", t.alias("EventTemplate"))
    return matching.assign_event_ids(s, "EventTemplate", "LineId")


_SQL_RAW_TRUTH = """
s AS (SELECT LineId, Content, gt AS c, CASE WHEN event_type IN ('error', 'view') THEN Content ELSE gt END AS t FROM r),
f AS (SELECT t, min(LineId) AS fl FROM s GROUP BY t),
ids AS (SELECT t, 'E' || cast(row_number() OVER (ORDER BY fl, t) AS varchar) AS EventId FROM f),
s2 AS (SELECT s.*, ids.EventId FROM s JOIN ids USING (t)),
m AS (SELECT c, min(EventId) AS new_id FROM s2 GROUP BY c)
"""


def correct_oracle(spark, sf_dir):
    """P10 + G7 + D22 + C4: corrected ids and templates of every line."""
    from logloom.operators.correction import correct
    lines, _, _ = correct(_raw_truth(spark, sf_dir))
    return lines.select("LineId", "EventId", "EventTemplate")


SQL_CORRECT_ORACLE = f"""WITH {R}, {_SQL_RAW_TRUTH}
SELECT s2.LineId, m.new_id AS EventId, s2.c AS EventTemplate FROM s2 JOIN m USING (c)
"""


def corrected_templates(spark, sf_dir):
    """E9 + D22: the corrected template table in natural id order."""
    from logloom.operators.correction import correct
    _, templates, _ = correct(_raw_truth(spark, sf_dir))
    return templates.select("EventId", "EventTemplate", F.col("pos").cast("int").alias("pos"))


SQL_CORRECTED_TEMPLATES = f"""WITH {R}, {_SQL_RAW_TRUTH}
SELECT new_id AS EventId, c AS EventTemplate,
       CAST(row_number() OVER (ORDER BY cast(substr(new_id, 2) AS BIGINT), new_id) AS INTEGER) AS pos FROM m
"""


def correction_counts(spark, sf_dir):
    """Templates before, after and changed."""
    from logloom.operators.correction import correction_counts as cc
    return cc(_raw_truth(spark, sf_dir))


SQL_CORRECTION_COUNTS = f"""WITH {R}, {_SQL_RAW_TRUTH}
SELECT count(*) AS n_original, count(DISTINCT c) AS n_corrected, sum(CASE WHEN t <> c THEN 1 ELSE 0 END)::BIGINT AS n_changed
FROM (SELECT DISTINCT t, c FROM s)
"""


# ---------------------------------------------------------------------------
# IO round trips (A5-A10, A13) and ordering
# ---------------------------------------------------------------------------

def structured_roundtrip(spark, sf_dir):
    """A9 + A5 + A6: write the structured truth log as CSV, read it back as strings."""
    from logloom.session import scratch_path
    from logloom.sources import io
    s = _raw_truth(spark, sf_dir).select("LineId", "EventId", "Content", "EventTemplate")
    path = scratch_path(spark, "structured-csv")
    io.write_structured(s, path, "csv")
    back = io.read_structured(spark, path, "csv")
    return back.select(F.col("LineId").cast("long").alias("LineId"), "EventId", "Content", "EventTemplate")


SQL_STRUCTURED_ROUNDTRIP = f"""WITH {R}, {_SQL_RAW_TRUTH}
SELECT LineId, EventId, Content, t AS EventTemplate FROM s2
"""


def examples_roundtrip(spark, sf_dir):
    """A10 + A8 + G29: every line with its truth template written as
    ``{query, answer}`` JSON lines and read back."""
    from logloom.session import scratch_path
    from logloom.sources import io
    ev = rendered_events(spark, sf_dir).select("LineId", F.col("Content").alias("query"), F.col("gt").alias("answer"))
    path = scratch_path(spark, "examples-json")
    io.write_examples(ev, path)
    back = io.read_examples(spark, path)
    return back.select("query", "answer")


SQL_EXAMPLES_ROUNDTRIP = f"WITH {R} SELECT Content AS query, replace(gt, '<*>', '{{variables}}') AS answer FROM r"


def longest_templates(spark, sf_dir):
    """Truth and clean-up templates ranked by length, longest first."""
    from pyspark.sql import Window
    ev = rendered_events(spark, sf_dir)
    t = ev.select(F.col("gt").alias("template")).unionByName(ev.select(F.col("expected").alias("template"))).distinct()
    w = Window.orderBy(F.length("template").desc(), "template")  # one row per template
    return t.select("template", F.length("template").alias("len"), F.row_number().over(w).cast("int").alias("rank"))


SQL_LONGEST_TEMPLATES = f"""WITH {R}, t AS (SELECT DISTINCT template FROM (SELECT gt AS template FROM r UNION ALL SELECT expected FROM r))
SELECT template, CAST(length(template) AS INTEGER) AS len,
       CAST(row_number() OVER (ORDER BY length(template) DESC, template) AS INTEGER) AS rank FROM t
"""


# ---------------------------------------------------------------------------
# streaming
# ---------------------------------------------------------------------------

def stream_parse(spark, sf_dir):
    """H1 + H2: the rendered log as Parquet files read by a file stream, one
    file per micro-batch, template table carried between batches; equals the
    batch parse."""
    from logloom.session import scratch_path
    from logloom.streaming import online
    ev = rendered_events(spark, sf_dir).select("LineId", "Content")
    base = scratch_path(spark, "stream")
    src = base + "/source"
    files = -(-max(4, int(spark.conf.get("spark.sql.shuffle.partitions"))) // 4)  # four batches of many files at any size
    last = ev.agg(F.max("LineId")).first()[0] or 0
    for i in range(4):  # a stream reads files in the order they come: a quarter of the log after the other
        part = ev.filter((F.col("LineId") > last * i // 4) & (F.col("LineId") <= last * (i + 1) // 4))
        part.repartitionByRange(files, "LineId").write.mode("append").parquet(src)
    q = online.start(spark, src, base + "/out", base + "/state", base + "/checkpoint", files_per_trigger=files)
    q.awaitTermination()
    out = online.read_output(spark, base + "/out")
    return out.select("LineId", "Content", "EventId", "EventTemplate")


QUERIES.update({
    "correct_oracle": (correct_oracle, SQL_CORRECT_ORACLE),
    "corrected_templates": (corrected_templates, SQL_CORRECTED_TEMPLATES),
    "correction_counts": (correction_counts, SQL_CORRECTION_COUNTS),
    "structured_roundtrip": (structured_roundtrip, SQL_STRUCTURED_ROUNDTRIP),
    "examples_roundtrip": (examples_roundtrip, SQL_EXAMPLES_ROUNDTRIP),
    "longest_templates": (longest_templates, SQL_LONGEST_TEMPLATES),
    "stream_parse": (stream_parse, SQL_EVENT_IDS),
})


# ---------------------------------------------------------------------------
# raw text logs (A2 B1), non-ASCII clean-up (A3), relevant templates (C10),
# template merge (P5)
# ---------------------------------------------------------------------------

def read_raw_log(spark, sf_dir):
    """A2 + B1: the rendered log written as text files, read back with
    ``spark.read.text``; line numbers follow file and position."""
    from logloom.session import scratch_path
    path = scratch_path(spark, "rawlog")
    raw = rendered_events(spark, sf_dir).select("LineId", F.col("raw").alias("value"))
    raw.repartitionByRange("LineId").sortWithinPartitions("LineId").select("value").write.text(path)
    parsed = formats.read_raw_logs(spark, path, EVENTS_FORMAT)
    return parsed.select("LineId", "Date", "Time", "Level", "Component", "Content")


def nonascii_clean(spark, sf_dir):
    """A3: document lines, blank ones skipped, non-ASCII runs -> <N/ASCII>."""
    d = table(spark, sf_dir, "documents", ["doc_id", "text"])
    lines = spread(d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "value"))
    out = formats.formalize_messages(lines, "<Content>")
    return out.select("doc_id", F.col("line_no").cast("int").alias("line_no"), "Content")


SQL_NONASCII_CLEAN = """
WITH l AS (SELECT doc_id, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS line_no,
                  unnest(string_split(text, chr(10))) AS v FROM documents)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, regexp_replace(regexp_replace(v, '[^\\x00-\\x7F]+', '<N/ASCII>', 'g'), '^\\s+|\\s+$', '', 'g') AS Content
FROM l WHERE regexp_replace(v, '\\s', '', 'g') <> ''
"""


def relevant_templates(spark, sf_dir):
    """For lines the purchase/click templates miss, the templates under
    the longest token prefix they share with any template."""
    ev = rendered_events(spark, sf_dir)
    tpl = ev.filter(F.col("event_type").isin("purchase", "click")).select(F.col("expected").alias("template")).distinct()
    tpl = tpl.withColumn("template_id", F.xxhash64("template"))
    sigs = ev.select(T.signature("Content").alias("sig")).distinct()
    r = matching.relevant_templates(sigs, tpl)
    return r.select("sig", F.col("depth").cast("int").alias("depth"), F.array_join("relevant", " || ").alias("relevant"))


SQL_RELEVANT_TEMPLATES = f"""
WITH {R},
m AS (SELECT DISTINCT regexp_extract_all(Content, '{_TOK_RE}') AS mt FROM r),
t AS (SELECT DISTINCT expected AS template, regexp_extract_all(expected, '{_TOK_RE}') AS tt FROM r
      WHERE event_type IN ('purchase', 'click')),
k AS (SELECT mt, template, len(list_filter(range(1, least(len(mt), len(tt)) + 1),
                                       lambda i: list_slice(mt, 1, i) = list_slice(tt, 1, i))) AS k FROM m, t),
best AS (SELECT mt, max(k) AS depth FROM k GROUP BY mt HAVING max(k) > 0)
SELECT array_to_string(best.mt, chr(31)) || chr(31) AS sig, CAST(best.depth AS INTEGER) AS depth,
       array_to_string(list_sort(list(k.template)), ' || ') AS relevant
FROM best JOIN k ON k.mt = best.mt AND k.k = best.depth GROUP BY best.mt, best.depth
"""


def merge_templates(spark, sf_dir):
    """P5 + G11 + G25: near-duplicate templates of the whole log merged by word LCS."""
    from logloom.operators.discovery import merge_similar
    _, tpl = parse(rendered_events(spark, sf_dir).select("LineId", "Content"))
    return merge_similar(tpl).select("template_id", "template", F.size("merged_from").alias("n_merged"))


def parse_by_dataset(spark, sf_dir):
    """P6 + E1 per dataset in one job: the log split into three systems."""
    ev = rendered_events(spark, sf_dir).select("LineId", "Content")
    ev = ev.withColumn("dataset", F.concat(F.lit("part"), ((F.col("LineId") - 1) % 3).cast("string")))
    s, _ = parse(ev, group_col="dataset")
    return matching.template_table(s, group_cols=["dataset"]).select("dataset", "EventId", "EventTemplate", "Occurrences")


SQL_PARSE_BY_DATASET = f"""
WITH {R}, d AS (SELECT 'part' || cast((LineId - 1) % 3 AS varchar) AS dataset, LineId, expected FROM r),
t AS (SELECT dataset, expected AS EventTemplate, count(*) AS Occurrences, min(LineId) AS f FROM d GROUP BY ALL)
SELECT dataset, 'E' || cast(row_number() OVER (PARTITION BY dataset ORDER BY f, EventTemplate) AS varchar) AS EventId,
       EventTemplate, Occurrences FROM t
"""


QUERIES.update({
    "parse_by_dataset": (parse_by_dataset, SQL_PARSE_BY_DATASET),
    "read_raw_log": (read_raw_log, SQL_PARSE_HEADER),
    "nonascii_clean": (nonascii_clean, SQL_NONASCII_CLEAN),
    "relevant_templates": (relevant_templates, SQL_RELEVANT_TEMPLATES),
})


def quota_by_dataset(spark, sf_dir):
    """P9 + E5 + E6 per dataset in one job: documents grouped by language."""
    from logloom.operators import sampling
    d = table(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    lab = d.select((F.col("doc_id") + 1).alias("row_id"), F.col("text").alias("Content"), F.col("lang").alias("dataset"))
    cl = sampling.clusters(sampling.prepare(lab, group_col="dataset"), "dataset")
    q = sampling.quotas(cl, order="key", group_col="dataset")
    return q.select("dataset", "shot", "coarse", "fine", "c_pos", "f_pos", "c_quota", "quota")


SQL_QUOTA_BY_DATASET = f"""
WITH d AS (SELECT doc_id + 1 AS row_id, text, lang FROM documents),
c AS (SELECT row_id, lang, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(text, '[:()=,"{{}}@\\[\\]|;]|\\.?!', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), '\\s+'),
                                 lambda w: w <> '' AND NOT regexp_matches(w, '[0-9]')) AS ws FROM d),
k AS (SELECT * FROM c WHERE len(ws) > 1),
vw AS (SELECT row_id, lang, unnest(ws) AS token FROM k),
vocab AS (SELECT lang, token, count(*) AS cnt FROM vw WHERE length(token) > 2 AND token NOT IN ({_SQL_STOP}) GROUP BY ALL),
dt AS (SELECT DISTINCT vw.row_id, vw.lang, vw.token FROM vw JOIN vocab USING (lang, token)),
rk AS (SELECT dt.row_id, dt.lang, dt.token, row_number() OVER (PARTITION BY dt.row_id ORDER BY v.cnt DESC, dt.token) AS rn
       FROM dt JOIN vocab v USING (lang, token)),
top AS (SELECT row_id, array_to_string(list_sort(list(token)), ' ') AS coarse FROM rk WHERE rn <= 3 GROUP BY row_id),
cl AS (SELECT k.row_id, k.lang, coalesce(top.coarse, '') AS coarse FROM k LEFT JOIN top USING (row_id)),
fi AS (SELECT d.row_id, array_to_string(list_sort(list_distinct(list_filter(string_split(regexp_replace(text, '[0-9A-Za-z, ]+', '', 'g'), ''), lambda z: z <> ''))), '') AS fine FROM d),
cf AS (SELECT cl.row_id, cl.lang, cl.coarse, fi.fine FROM cl JOIN fi USING (row_id)),
fs AS (SELECT lang, coarse, fine, count(*) AS size FROM cf GROUP BY ALL),
cs AS (SELECT lang, coarse, count(DISTINCT fine) AS n_fine FROM cf GROUP BY ALL),
nc AS (SELECT lang, count(*) AS c FROM cs GROUP BY lang),
cp AS (SELECT lang, coarse, n_fine, row_number() OVER (PARTITION BY lang ORDER BY coarse) - 1 AS c_pos FROM cs),
sh AS (SELECT unnest([8, 16, 32, 64, 128]) AS shot),
cq AS (SELECT shot, cp.lang, coarse, n_fine, c_pos,
              CAST(floor(shot / c) + CASE WHEN c_pos < shot % c THEN 1 ELSE 0 END AS INTEGER) AS c_quota
       FROM cp JOIN nc USING (lang), sh),
fp AS (SELECT lang, coarse, fine, row_number() OVER (PARTITION BY lang, coarse ORDER BY size DESC, fine) - 1 AS f_pos FROM fs),
j AS (SELECT cq.lang, cq.shot, cq.coarse, fp.fine, cq.c_pos, fp.f_pos, cq.c_quota,
             CAST(floor(c_quota / n_fine) + CASE WHEN f_pos < c_quota % n_fine THEN 1 ELSE 0 END AS INTEGER) AS quota
      FROM cq JOIN fp USING (lang, coarse) WHERE cq.c_quota > 0)
SELECT lang AS dataset, shot, coarse, fine, CAST(c_pos AS INTEGER) AS c_pos, CAST(f_pos AS INTEGER) AS f_pos, c_quota, quota
FROM j WHERE quota > 0
"""

QUERIES["quota_by_dataset"] = (quota_by_dataset, SQL_QUOTA_BY_DATASET)

from logloom.plans.files import QUERIES as _FILES  # noqa: E402
from logloom.plans.samples import QUERIES as _SAMPLES  # noqa: E402
from logloom.plans.varied import QUERIES as _VARIED, merge_sql  # noqa: E402

SQL_MERGE_TEMPLATES = merge_sql(f"""{R},
ft AS (SELECT expected AS template, min(LineId) AS f FROM r GROUP BY expected),
t AS (SELECT template, row_number() OVER (ORDER BY f, template) - 1 AS id FROM ft)""")

QUERIES.update(_SAMPLES)
QUERIES.update(_VARIED)
QUERIES.update(_FILES)
QUERIES["merge_templates"] = (merge_templates, SQL_MERGE_TEMPLATES)
