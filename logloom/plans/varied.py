"""Registered queries over the varied log (``fixtures.VARIED_SQL``) and over large template tables,
with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators import matching
from logloom.session import spread
from logloom.sources.fixtures import VARIED_SQL, table, varied_events

V = f"v AS ({VARIED_SQL})"
TOKEN_RE = r"""[^\s!"#$%&''()+,\-/:;=?@.\[\\\]^_`{|}~]+|[=|()]"""

QUERIES: dict[str, tuple] = {}


# ---------------------------------------------------------------------------
# H3: line by line, each line sees only earlier templates
# ---------------------------------------------------------------------------

def parse_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H3 + E1 + C1: the varied log read line by line, as an as-of match."""
    from logloom.operators.sequential import parse_sequential as sequential
    structured, _ = sequential(varied_events(spark, sf_dir).select("LineId", "Content"))
    return structured.select("LineId", "EventId", "EventTemplate")


#: msg: distinct messages with their first line, rule template and the numbers of the rule templates
#: whose tokens cover theirs; tpl: the rule templates and their ranks.
_SQL_COVER = f"""
tk AS (SELECT rule, array_to_string(list_transform(regexp_extract_all(rule, '{TOKEN_RE}'), lambda z: CASE WHEN contains(z, '<*>') THEN '<*>' ELSE z END), chr(31)) || chr(31) AS ts
       FROM (SELECT DISTINCT rule FROM v)),
tw AS (SELECT rule, list_filter(string_split(regexp_replace(ts, '(<\\*>' || chr(31) || '){{2,}}', '<*>' || chr(31), 'g'), chr(31)), lambda z: z <> '') AS t FROM tk),
tpl AS (SELECT row_number() OVER (ORDER BY rule) AS tid, rule, len(list_filter(t, lambda z: z <> '<*>')) AS n_static,
               len(list_filter(t, lambda z: z = '<*>')) AS n_wild, list_transform(t, lambda z: CASE WHEN z = '<*>' THEN 1 ELSE 0 END) AS flags,
               '^' || array_to_string(list_transform(t, lambda z: CASE WHEN z = '<*>' THEN '(?:[^' || chr(31) || ']*' || chr(31) || ')*' ELSE '\\Q' || z || '\\E' || chr(31) END), '') || '$' AS rx
        FROM tw),
ms AS (SELECT Content, rule, min(LineId) AS first, array_to_string(regexp_extract_all(Content, '{TOKEN_RE}'), chr(31)) || chr(31) AS s FROM v GROUP BY Content, rule),
msg AS (SELECT ms.Content, any_value(ms.first) AS first, any_value(o.tid) AS own, list(tpl.tid) AS cover
        FROM ms JOIN tpl o ON o.rule = ms.rule JOIN tpl ON regexp_matches(ms.s, tpl.rx) GROUP BY ms.Content)
"""

SQL_PARSE_SEQUENTIAL = f"""
WITH RECURSIVE {V}, {_SQL_COVER},
births AS (
  SELECT CAST(0 AS BIGINT) AS line, CAST([] AS BIGINT[]) AS tids
  UNION ALL
  SELECT min(msg.first) AS line, list_append(any_value(births.tids), arg_min(msg.own, msg.first)) AS tids
  FROM births JOIN msg ON msg.first > births.line AND NOT list_has_any(msg.cover, births.tids)
  GROUP BY births.line
),
born AS (SELECT line, tids[len(tids)] AS tid FROM births WHERE line > 0),
best AS (SELECT v.LineId, v.rule, arg_min(tpl.rule, struct_pack(a := -tpl.n_static, b := tpl.n_wild, c := tpl.flags, d := born.line)) AS top
         FROM v JOIN msg ON msg.Content = v.Content LEFT JOIN born ON born.line < v.LineId AND list_contains(msg.cover, born.tid)
         LEFT JOIN tpl ON tpl.tid = born.tid GROUP BY v.LineId, v.rule),
parsed AS (SELECT LineId, coalesce(top, rule) AS EventTemplate FROM best),
ids AS (SELECT EventTemplate, 'E' || cast(row_number() OVER (ORDER BY min(LineId), EventTemplate) AS varchar) AS EventId FROM parsed GROUP BY EventTemplate)
SELECT LineId, EventId, EventTemplate FROM parsed JOIN ids USING (EventTemplate)
"""
QUERIES["parse_sequential"] = (parse_sequential, SQL_PARSE_SEQUENTIAL)


# ---------------------------------------------------------------------------
# C1 with a template for every order: leading wildcards, and one crowded prefix
# ---------------------------------------------------------------------------

_SHIPPED = """CASE WHEN l_orderkey % 2 = 0 THEN 'truck ' || cast(l_suppkey as string) || ' ships order ok' || cast(l_orderkey as string) || ' for part ' || cast(l_partkey as string)
    ELSE 'order shipped by carrier ' || cast(l_suppkey as string) || ' number ok' || cast(l_orderkey as string) || ' part ' || cast(l_partkey as string) END"""
_ORDER_TEMPLATE = """CASE WHEN o_orderkey % 2 = 0 THEN '<*> ships order ok' || cast(o_orderkey as string) || ' for <*>'
    ELSE 'order shipped by carrier <*> number ok' || cast(o_orderkey as string) || ' part <*>' END"""


def match_many_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 + E2: shipment messages (one a line item) against a template for every third order and two general ones."""
    items = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"])
    items = items.withColumn("Content", F.expr(_SHIPPED))
    orders = table(spark, sf_dir, "orders", ["o_orderkey"]).where("o_orderkey % 3 <> 0")
    tpl = orders.select((F.col("o_orderkey") + 2).alias("template_id"), F.expr(_ORDER_TEMPLATE).alias("template"))
    general = spark.createDataFrame([(0, "<*> ships order <*>"), (1, "order shipped by carrier <*> number <*>")], "template_id long, template string")
    found = matching.match_messages(items, tpl.unionByName(general))
    return found.groupBy("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "template_id", "template").agg(F.count("*").alias("n"))


SQL_MATCH_MANY_TEMPLATES = f"""
WITH t AS (SELECT o_orderkey, o_orderkey + 2 AS template_id, {_ORDER_TEMPLATE} AS template FROM orders WHERE o_orderkey % 3 <> 0)
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, coalesce(template_id, CASE WHEN l_orderkey % 2 = 0 THEN 0 ELSE 1 END) AS template_id,
       coalesce(template, CASE WHEN l_orderkey % 2 = 0 THEN '<*> ships order <*>' ELSE 'order shipped by carrier <*> number <*>' END) AS template, count(*) AS n
FROM lineitem LEFT JOIN t ON o_orderkey = l_orderkey GROUP BY ALL
"""
QUERIES["match_many_templates"] = (match_many_templates, SQL_MATCH_MANY_TEMPLATES)


# ---------------------------------------------------------------------------
# Near-duplicate templates of a large template table
# ---------------------------------------------------------------------------

_PART_TEMPLATE = "p_name || ' brand ' || p_brand || ' type ' || p_type || ' size ' || cast(p_size as string) || ' ok'"


def merge_part_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5 + G11 + G25: a template for every kind of part, near duplicates merged by word LCS."""
    from logloom.operators.discovery import merge_similar
    parts = table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size"])
    tpl = parts.groupBy(F.expr(_PART_TEMPLATE).alias("template")).agg(F.min("p_partkey").alias("template_id"))
    return merge_similar(tpl).select("template_id", "template", F.size("merged_from").alias("n_merged"))


#: LCS lengths of the pairs (a, b, x, y) of `cand`: a row of the table of one word after the other.
_SQL_LCS = """
dp AS (
  SELECT a, b, x, y, 0 AS i, list_transform(range(len(y) + 1), lambda j: 0) AS row FROM cand
  UNION ALL
  SELECT a, b, x, y, i + 1, list_transform(range(len(y) + 1), lambda j: CASE WHEN j = 0 THEN 0 ELSE CAST(list_max(list_transform(range(1, j + 1),
    lambda k: greatest(row[k + 1], CASE WHEN x[i + 1] = y[k] THEN row[k] + 1 ELSE 0 END))) AS INTEGER) END)
  FROM dp WHERE i < len(x)
),
lcs AS (SELECT a, b, x, y, row[len(y) + 1] AS n FROM dp WHERE i = len(x))
"""

def merge_sql(templates: str) -> str:
    """Merged templates of the CTEs ``templates``, the last of which is ``t(id, template)``."""
    return f"""
WITH RECURSIVE {templates},
w AS (SELECT id, template, string_split(template, ' ') AS ws FROM t),
e AS (SELECT id, word, count(*) AS c FROM (SELECT id, unnest(ws) AS word FROM w) GROUP BY ALL),
o AS (SELECT p.id AS a, q.id AS b, sum(least(p.c, q.c)) AS shared FROM e p JOIN e q ON p.word = q.word AND p.id < q.id GROUP BY ALL),
cand AS (SELECT o.a, o.b, p.ws AS x, q.ws AS y FROM o JOIN w p ON p.id = o.a JOIN w q ON q.id = o.b
         WHERE len(p.ws) = len(q.ws) AND p.ws[1] = q.ws[1] AND shared > 0.8 * len(p.ws)),
{_SQL_LCS},
near AS (SELECT b, a, x, y, row_number() OVER (PARTITION BY b ORDER BY n DESC, a) AS rn FROM lcs WHERE 2.0 * n / (len(x) + len(y)) > 0.8),
best AS (SELECT b, a, y FROM near WHERE rn = 1),
diff AS (SELECT a, list(y) AS ys, count(*) AS n FROM best GROUP BY a)
SELECT w.id AS template_id,
       array_to_string(list_transform(range(1, len(ws) + 1), lambda i: CASE WHEN len(list_filter(coalesce(ys, []), lambda z: z[i] <> ws[i])) = 0 THEN ws[i] ELSE '<*>' END), ' ') AS template,
       CAST(coalesce(n, 0) AS INTEGER) AS n_merged
FROM w LEFT JOIN diff ON diff.a = w.id WHERE w.id NOT IN (SELECT b FROM best)
"""


SQL_MERGE_PART_TEMPLATES = merge_sql(f"t AS (SELECT {_PART_TEMPLATE} AS template, min(p_partkey) AS id FROM part GROUP BY 1)")
QUERIES["merge_part_templates"] = (merge_part_templates, SQL_MERGE_PART_TEMPLATES)


def lcs_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G12 + G14: word-LCS and edit distance between the varied log's messages and the truth of their line."""
    from logloom.functions.distance import lcs_distance, levenshtein_distance
    pairs = varied_events(spark, sf_dir).where("gt is not null").select("Content", "gt").distinct()
    return pairs.select("Content", "gt", F.round(lcs_distance("Content", "gt"), 6).alias("lcs"), F.round(levenshtein_distance("Content", "gt"), 6).alias("lev"))


SQL_LCS_DISTANCES = f"""
WITH RECURSIVE {V}, p AS (SELECT DISTINCT Content AS a, gt AS b FROM v WHERE gt IS NOT NULL),
cand AS (SELECT a, b, string_split(a, ' ') AS x, string_split(b, ' ') AS y FROM p),
{_SQL_LCS}
SELECT a AS Content, b AS gt, round(1.0 - 2.0 * n / (len(x) + len(y)), 6) AS lcs,
       round(levenshtein(a, b) * 1.0 / greatest(length(a), length(b)), 6) AS lev FROM lcs
"""
QUERIES["lcs_distances"] = (lcs_distances, SQL_LCS_DISTANCES)


# ---------------------------------------------------------------------------
# G5 on runs of any length
# ---------------------------------------------------------------------------

def mask_long_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys repeated into unbroken runs of four-digit groups, 4 to 400 of them."""
    from logloom.functions.text import mask_variables
    runs = spread(table(spark, sf_dir, "orders", ["o_orderkey"])).selectExpr(
        "o_orderkey", "'dump ' || repeat(lpad(cast(o_orderkey % 10000 as string), 4, 'A'), cast(4 + o_orderkey % 397 as int)) || ' end' AS line")
    return runs.select("o_orderkey", mask_variables("line").alias("masked"))


QUERIES["mask_long_runs"] = (mask_long_runs, "SELECT o_orderkey, 'dump <*> end' AS masked FROM orders")


# ---------------------------------------------------------------------------
# Truth and parse stored apart
# ---------------------------------------------------------------------------

def score_stored_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2 + A6 + B3 + D2-D7: truth (some NULL) and parse (some lines missing) stored bucketed by line, aligned
    without a shuffle, and scored by system."""
    from logloom.functions.text import propose_template
    from logloom.operators import metrics
    from logloom.session import scratch_path
    from logloom.sources.io import save_by_line
    ev = varied_events(spark, sf_dir)
    truth = save_by_line(ev.select("dataset", "LineId", F.col("gt").alias("EventTemplate")), scratch_path(spark, "truth"))
    parsed = ev.where("LineId % 50 <> 7").select("dataset", "LineId", propose_template(F.col("Content")).alias("EventTemplate"))
    pairs = metrics.pair_counts(metrics.align(truth, save_by_line(parsed, scratch_path(spark, "parse"))))
    out = metrics.grouping_accuracy(pairs).join(metrics.parsing_accuracy(pairs), "dataset").join(metrics.template_accuracy(pairs), "dataset")
    return out.select("dataset", "tool_templates", "ground_templates", *[F.round(c, 6).alias(c) for c in ("GA", "PGA", "RGA", "FGA", "PA", "PTA", "RTA", "FTA")])


SQL_SCORE_STORED_APART = f"""
WITH {V}, p AS (SELECT dataset, gt, CASE WHEN LineId % 50 = 7 THEN '' ELSE rule END AS parsed, count(*) AS n FROM v GROUP BY ALL),
q AS (SELECT * FROM p WHERE gt IS NOT NULL),
pp AS (SELECT dataset, parsed, sum(n) AS size_p, count(*) AS k, min(gt) AS gt1 FROM q GROUP BY ALL),
pg AS (SELECT dataset, gt, sum(n) AS size_g, count(*) AS k, min(parsed) AS parsed FROM q GROUP BY ALL),
g AS (SELECT pg.dataset, sum(CASE WHEN pg.k = 1 AND size_g = size_p THEN size_g ELSE 0 END) * 1.0 / sum(size_g) AS GA,
             sum(CASE WHEN pg.k = 1 AND size_g = size_p THEN 1 ELSE 0 END) AS c, count(*) AS n_gt FROM pg JOIN pp USING (dataset, parsed) GROUP BY pg.dataset),
t AS (SELECT dataset, count(*) AS tools, sum(CASE WHEN k = 1 AND parsed = gt1 THEN 1 ELSE 0 END) AS ok FROM pp GROUP BY dataset),
a AS (SELECT dataset, sum(CASE WHEN parsed = gt THEN n ELSE 0 END) * 1.0 / sum(n) AS PA FROM p GROUP BY dataset),
r AS (SELECT dataset, tools, n_gt, GA, PA, c * 1.0 / tools AS PGA, c * 1.0 / n_gt AS RGA, ok * 1.0 / tools AS PTA, ok * 1.0 / n_gt AS RTA FROM g JOIN t USING (dataset) JOIN a USING (dataset))
SELECT dataset, tools AS tool_templates, n_gt AS ground_templates, round(GA, 6) AS GA, round(PGA, 6) AS PGA, round(RGA, 6) AS RGA,
       round(CASE WHEN PGA + RGA > 0 THEN 2 * PGA * RGA / (PGA + RGA) ELSE 0 END, 6) AS FGA, round(PA, 6) AS PA, round(PTA, 6) AS PTA, round(RTA, 6) AS RTA,
       round(CASE WHEN PTA + RTA > 0 THEN 2 * PTA * RTA / (PTA + RTA) ELSE 0 END, 6) AS FTA FROM r
"""
QUERIES["score_stored_apart"] = (score_stored_apart, SQL_SCORE_STORED_APART)


# ---------------------------------------------------------------------------
# B1 over many files
# ---------------------------------------------------------------------------

FILE_LINES = 10
#: Lines whose files lie in one folder, written by one task.
FOLDER_LINES = 500 * FILE_LINES


def _write_files(path: str):
    """A function for ``mapInArrow`` over (place, value), sorted by place in each task: every ``FILE_LINES`` places make
    a file, whole or not there.  The result is a row a file; a task that runs again writes the same files."""
    import uuid

    import pyarrow as pa
    from pyarrow import fs as pafs
    lines, files = FILE_LINES, FOLDER_LINES // FILE_LINES

    uri = path if "://" in path or path.startswith("file:") else "file://" + path
    fs, base = pafs.FileSystem.from_uri(uri)
    fs.create_dir(base, recursive=True)  # a log without lines is an empty folder

    def fn(it):
        fs, base = pafs.FileSystem.from_uri(uri)
        task, folder = uuid.uuid4().hex, None

        def store(number, part):
            nonlocal folder
            if folder != (folder := f"{base}/folder={number // files:012d}"):
                fs.create_dir(folder, recursive=True)
            at = f"{folder}/.{number:014d}-{task}"
            with fs.open_output_stream(at) as f:
                f.write("".join(("" if v is None else v) + "\n" for v in part).encode())
            fs.move(at, f"{folder}/{number:014d}.txt")
            return number

        number, part = None, []
        for batch in it:
            done = []
            for place, value in zip(batch.column("place").to_pylist(), batch.column("value").to_pylist()):
                if place // lines != number and part:
                    done.append(store(number, part))
                    part = []
                number = place // lines
                part.append(value)
            yield pa.record_batch({"file": pa.array(done, pa.int64())})
        if part:
            yield pa.record_batch({"file": pa.array([store(number, part)], pa.int64())})
    return fn


def read_many_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 + B1: the varied log written as one text file for every ten lines, read back with consecutive line numbers.

    The lines get their places by ranges, and a task writes the files of whole folders of ``FOLDER_LINES`` lines;
    folders and files have their lines' order.  They are read by tasks that get whole runs of files."""
    from logloom.session import ranked, scratch_path
    from logloom.sources import formats
    path = scratch_path(spark, "manyfiles")
    ev = varied_events(spark, sf_dir).select("LineId", F.concat(F.lit("app: "), "Content").alias("value"))
    placed = ranked(ev, ["LineId"], "place", 0)
    folder = F.floor(F.col("place") / FOLDER_LINES)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.repartition(tasks, folder).sortWithinPartitions("place").select("place", "value")
    placed.mapInArrow(_write_files(path), "file long").write.format("noop").mode("overwrite").save()
    return formats.read_raw_logs(spark, path, "<Component>: <Content>", small_files=True).select("LineId", "Content")


QUERIES["read_many_files"] = (read_many_files, f"WITH {V} SELECT LineId, Content FROM v")


# ---------------------------------------------------------------------------
# A model's templates;  D26: proposals of each round
# ---------------------------------------------------------------------------

def kind_proposer(asked):
    """A stand-in for a model that knows three kinds of lines: it answers them with a general
    template, pool lines with one that does not match them, and the rest in prose."""
    import pandas as pd
    kinds = [("worker ", "Log template: `worker {name} finished job {id}`"), ("open ", "Log template: `open {path} failed`"),
             ("flag ", "The template is:\nLog template: `flag {value} set by {user}`"), ("pool ", "Log template: `pond {id}`")]
    questions = [m[-1]["content"].removeprefix("Log message: `") for m in asked["messages"]]
    return pd.Series([next((a for start, a in kinds if q.startswith(start)), "I can't say") for q in questions])


def parse_with_proposer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1 + P3 + P6 + B9 + G21 + G24: the varied log parsed with a proposer; answers that don't match their own
    message, and those without a template, give way to the rules; one-word lines are not asked."""
    from logloom.operators.discovery import parse
    structured, _ = parse(varied_events(spark, sf_dir).select("LineId", "Content"), proposer=kind_proposer)
    return structured.select("LineId", "EventTemplate")


SQL_PARSE_WITH_PROPOSER = f"""
WITH {V} SELECT LineId, CASE WHEN starts_with(rule, 'worker ') THEN 'worker <*> finished job <*>' WHEN starts_with(rule, 'open ') THEN 'open <*> failed'
  WHEN starts_with(rule, 'flag ') THEN 'flag <*> set by <*>' ELSE rule END AS EventTemplate FROM v
"""
QUERIES["parse_with_proposer"] = (parse_with_proposer, SQL_PARSE_WITH_PROPOSER)


def proposals_per_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals of each discovery round over the varied log, observed while its tables are written."""
    from logloom.operators.discovery import discover
    stats: list = []
    discover(varied_events(spark, sf_dir).select("LineId", "Content"), stats=stats)
    return spark.createDataFrame([(s["round"], s["proposals"]) for s in stats], "round int, proposals long")


SQL_PROPOSALS_PER_ROUND = f"""
WITH {V}, {_SQL_COVER},
n AS (SELECT 1 + CAST(floor(max(LineId) * 0.01) AS BIGINT) AS b1, 1 + CAST(floor(max(LineId) * 0.1) AS BIGINT) AS b2 FROM v),
r1 AS (SELECT coalesce(list(DISTINCT own), []) AS t FROM msg, n WHERE first <= b1),
r2 AS (SELECT coalesce(list(DISTINCT own), []) AS t FROM msg, n, r1 WHERE first <= b2 AND NOT list_has_any(cover, r1.t)),
r3 AS (SELECT coalesce(list(DISTINCT own), []) AS t FROM msg, r1, r2 WHERE NOT list_has_any(cover, list_concat(r1.t, r2.t)))
SELECT 1 AS round, len(t) AS proposals FROM r1 UNION ALL SELECT 2, len(t) FROM r2 UNION ALL SELECT 3, len(t) FROM r3
"""
QUERIES["proposals_per_round"] = (proposals_per_round, SQL_PROPOSALS_PER_ROUND)


# ---------------------------------------------------------------------------
# A stream that stops and goes on
# ---------------------------------------------------------------------------

def stream_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2 + A15 + P1: the varied log as a file stream parsed with a proposer; the query ends after the first half of the
    files, and a new one goes on from its state and answers."""
    from logloom.session import scratch_path
    from logloom.streaming import online
    base = scratch_path(spark, "restart")
    ev = varied_events(spark, sf_dir).select("LineId", "Content")
    last = ev.agg(F.max("LineId")).first()[0] or 0
    for i in range(4):  # two batches for each of two queries
        part = ev.filter((F.col("LineId") > last * i // 4) & (F.col("LineId") <= last * (i + 1) // 4))
        part.repartitionByRange(2, "LineId").write.mode("append").parquet(base + "/source")
        if i % 2:
            q = online.start(spark, base + "/source", base + "/out", base + "/state", base + "/checkpoint", files_per_trigger=2,
                             proposer=kind_proposer, answers_dir=base + "/answers")
            q.awaitTermination()
    return online.read_output(spark, base + "/out").select("LineId", "EventId", "EventTemplate")


SQL_STREAM_RESTART = f"""
WITH {V}, p AS ({SQL_PARSE_WITH_PROPOSER.split(V, 1)[1]}),
ids AS (SELECT EventTemplate, 'E' || cast(row_number() OVER (ORDER BY min(LineId), EventTemplate) AS varchar) AS EventId FROM p GROUP BY EventTemplate)
SELECT LineId, EventId, EventTemplate FROM p JOIN ids USING (EventTemplate)
"""
QUERIES["stream_restart"] = (stream_restart, SQL_STREAM_RESTART)
