"""Registered sampling queries with their DuckDB oracles: seeded draws by md5, so both engines draw the same lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import text as T
from logloom.operators import sampling
from logloom.sources.fixtures import table

_STOP = ", ".join("'" + w + "'" for w in T.SAMPLER_STOPWORDS)
_SHOTS = ", ".join(str(s) for s in sampling.SHOTS)


def _hash(*parts: str) -> str:
    """``sampling._hash`` of SQL expressions."""
    return "('0x' || substr(md5(" + " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "), 1, 15))::BIGINT"


# ---------------------------------------------------------------------------
# Hierarchical samples of documents
# ---------------------------------------------------------------------------

def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"])
    return d.select(F.col("lang").alias("dataset"), (F.col("doc_id") + 1).alias("row_id"),
                    F.col("text").alias("Content"), F.col("source").alias("EventTemplate"))


def hierarchical_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E7 + E13 + B13 + G29: hashed draws for every shot."""
    s = sampling.hierarchical_sample(_documents(spark, sf_dir), share=None)
    return s.select("shot", "sample_pos", "row_id", "answer")


def sample_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D19 + D24 + F5: templates covered per shot."""
    lab = _documents(spark, sf_dir)
    return sampling.coverage(sampling.hierarchical_sample(lab, share=None), lab, share=None)


def first_share_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2 + E7 + E13: samples of the first fifth of the rows."""
    s = sampling.hierarchical_sample(_documents(spark, sf_dir), share=0.2)
    return s.select("shot", "sample_pos", "row_id", "answer")


def sample_by_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9 + E7 + E13: hashed draws for every shot and language in one job."""
    s = sampling.hierarchical_sample(_documents(spark, sf_dir), share=None, group_col="dataset")
    return s.select("dataset", "shot", "sample_pos", "row_id", "answer")


def mean_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D20 + D19 + P9: coverage per shot, averaged over the languages."""
    lab = _documents(spark, sf_dir)
    cov = sampling.coverage(sampling.hierarchical_sample(lab, share=None, group_col="dataset"), lab, share=None,
                            group_col="dataset")
    return sampling.mean_by_shot(cov).select("shot", "covered", "n_templates", F.round("coverage", 6).alias("coverage"))


def _hierarchical_sql(dataset: str, where: str = "true") -> str:
    """CTEs up to ``s(dataset, shot, sample_pos, row_id, template)`` for documents grouped by ``dataset``."""
    return f"""
d AS (SELECT {dataset} AS g, doc_id + 1 AS row_id, text, source FROM documents WHERE {where}),
c AS (SELECT g, row_id, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(text, '[:()=,"{{}}@\\[\\]|;]|\\.?!', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), '\\s+'),
                                    lambda w: w <> '' AND NOT regexp_matches(w, '[0-9]')) AS ws FROM d),
k AS (SELECT * FROM c WHERE len(ws) > 1),
vw AS (SELECT g, row_id, unnest(ws) AS token FROM k),
vocab AS (SELECT g, token, count(*) AS cnt FROM vw WHERE length(token) > 2 AND token NOT IN ({_STOP}) GROUP BY ALL),
rk AS (SELECT g, row_id, token, row_number() OVER (PARTITION BY g, row_id ORDER BY cnt DESC, token) AS rn
       FROM (SELECT DISTINCT g, row_id, token FROM vw) JOIN vocab USING (g, token)),
top AS (SELECT g, row_id, array_to_string(list_sort(list(token)), ' ') AS coarse FROM rk WHERE rn <= 3 GROUP BY ALL),
fi AS (SELECT g, row_id, array_to_string(list_sort(list_distinct(list_filter(string_split(regexp_replace(text, '[0-9A-Za-z, ]+', '', 'g'), ''), lambda z: z <> ''))), '') AS fine FROM d),
cf AS (SELECT k.g, k.row_id, coalesce(top.coarse, '') AS coarse, fi.fine, {_hash('0', 'k.row_id')} AS h
       FROM k LEFT JOIN top USING (g, row_id) JOIN fi USING (g, row_id)),
fs AS (SELECT g, coarse, fine, count(*) AS size FROM cf GROUP BY ALL),
cs AS (SELECT g, coarse, count(*) AS n_fine FROM fs GROUP BY ALL),
cp AS (SELECT g, coarse, n_fine, row_number() OVER (PARTITION BY g ORDER BY {_hash('0', 'coarse')}, coarse) - 1 AS c_pos,
              count(*) OVER (PARTITION BY g) AS n_coarse FROM cs),
cq AS (SELECT shot, cp.*, shot // n_coarse + CASE WHEN c_pos < shot % n_coarse THEN 1 ELSE 0 END AS c_quota
       FROM cp, (SELECT unnest([{_SHOTS}]) AS shot)),
fp AS (SELECT *, row_number() OVER (PARTITION BY g, coarse ORDER BY size DESC, fine) - 1 AS f_pos FROM fs),
j AS (SELECT g, shot, coarse, fine, size, c_pos, f_pos, c_quota // n_fine + CASE WHEN f_pos < c_quota % n_fine THEN 1 ELSE 0 END AS quota
      FROM cq JOIN fp USING (g, coarse)),
dr AS (SELECT *, {_hash('0', 'shot', 'coarse', 'fine', 'draw')} % size AS i
       FROM (SELECT *, unnest(range(1, quota + 1)) AS draw FROM j)),
mem AS (SELECT g, coarse, fine, row_id, row_number() OVER (PARTITION BY g, coarse, fine
               ORDER BY h % greatest(1, CAST(ceil(size / {sampling.BUCKET_ROWS}) AS BIGINT)), h, row_id) - 1 AS i
        FROM cf JOIN fs USING (g, coarse, fine)),
s AS (SELECT dr.g AS dataset, CAST(shot AS INTEGER) AS shot, row_id, source AS template,
             CAST(row_number() OVER (PARTITION BY dr.g, shot ORDER BY c_pos, f_pos, draw) AS INTEGER) AS sample_pos
      FROM dr JOIN mem USING (g, coarse, fine, i) JOIN d USING (g, row_id) QUALIFY sample_pos <= shot)
"""


_ANSWER = "replace(template, '<*>', '{variables}') AS answer"
_COVERAGE = """
n AS (SELECT g AS dataset, count(DISTINCT source) AS n_templates FROM d GROUP BY g),
cov AS (SELECT dataset, shot, count(DISTINCT template) AS covered, any_value(n_templates) AS n_templates,
               round(count(DISTINCT template) / least(any_value(n_templates), shot), 6) AS coverage
        FROM s JOIN n USING (dataset) GROUP BY dataset, shot)
"""
_FIRST = "doc_id + 1 <= (SELECT CAST(floor(0.2 * count(*)) AS BIGINT) FROM documents)"

SQL_HIERARCHICAL_SAMPLE = f"WITH {_hierarchical_sql('0')} SELECT shot, sample_pos, row_id, {_ANSWER} FROM s"
SQL_SAMPLE_COVERAGE = f"WITH {_hierarchical_sql('0')}, {_COVERAGE} SELECT shot, covered, n_templates, coverage FROM cov"
SQL_FIRST_SHARE_SAMPLE = f"WITH {_hierarchical_sql('0', _FIRST)} SELECT shot, sample_pos, row_id, {_ANSWER} FROM s"
SQL_SAMPLE_BY_DATASET = f"""WITH {_hierarchical_sql('lang')}
SELECT dataset, shot, sample_pos, row_id, {_ANSWER} FROM s WHERE dataset IS NOT NULL"""
SQL_MEAN_COVERAGE = f"""WITH {_hierarchical_sql('lang')}, {_COVERAGE}
SELECT shot, avg(covered) AS covered, avg(n_templates) AS n_templates, round(avg(coverage), 6) AS coverage FROM cov GROUP BY shot"""


# ---------------------------------------------------------------------------
# Farthest-point samples of conversation turns
# ---------------------------------------------------------------------------

def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    return conv.select(F.col("role").alias("dataset"), (F.col("conv_id") * 1048576 + F.col("turn") + 1).alias("row_id"),
                       F.col("text").alias("Content"), F.col("role").alias("EventTemplate"))


def farthest_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E11 + C8 + G10: farthest-point samples of conversation texts."""
    return sampling.farthest_sample(_turns(spark, sf_dir), share=None).select("shot", "sample_pos", "row_id")


def farthest_by_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E11 + C8 + G10 + P9: farthest-point samples of the turns of every role, all shots in one job."""
    s = sampling.farthest_sample(_turns(spark, sf_dir), share=None, group_col="dataset")
    return s.select("dataset", "shot", "sample_pos", "row_id")


def _farthest_sql(dataset: str) -> str:
    """The greedy as a recursion over rounds: every line keeps its distance to the nearest pick so far.

    Words are numbered among their equals, so that a set's intersection counts them as often as they repeat."""
    rounds, n_candidate = max(sampling.SHOTS) - 1, 128
    spaces, odd = "'\\s+'", "'[:()=,\"{}@\\[\\]|;.]|$'"
    return f"""
WITH RECURSIVE t AS (SELECT {dataset} AS g, conv_id * 1048576 + turn + 1 AS row_id, text FROM conversations),
w1 AS (SELECT g, row_id, length(text) AS orig_len, array_to_string(list_transform(
         list_filter(regexp_split_to_array(regexp_replace(text, {odd}, ' ', 'g'), {spaces}), lambda w: w <> ''),
         lambda w: CASE WHEN upper(w) = w AND lower(w) <> w THEN lower(w) ELSE w END), ' ') AS x FROM t),
w2 AS (SELECT g, row_id, orig_len, regexp_replace(array_to_string(list_filter(regexp_split_to_array(
         regexp_replace(regexp_replace(x, '([A-Z]+)', ' \\1', 'g'), '([A-Z][a-z]+)', ' \\1', 'g'), {spaces}),
         lambda w: w <> '' AND NOT regexp_matches(w, '[0-9]')), ' '), '[{T.PUNCT_CLASS}]', '', 'g') AS x FROM w1),
w3 AS (SELECT g, row_id, orig_len, list_transform(list_filter(regexp_split_to_array(x, {spaces}), lambda w: w <> ''), lambda w: lower(w)) AS ws FROM w2),
l AS (SELECT * FROM w3 WHERE len(ws) > 1),
nw AS (SELECT row_id, list(w || '#' || rn) AS ws
       FROM (SELECT row_id, w, row_number() OVER (PARTITION BY row_id, w) AS rn FROM (SELECT row_id, unnest(ws) AS w FROM l)) GROUP BY row_id),
st AS (SELECT g, count(*) AS n, arg_max(row_id, struct_pack(a := len(ws), b := orig_len, c := -row_id)) AS first FROM l GROUP BY g),
gaps AS (SELECT l.g, row_id, k, CASE WHEN n <= {n_candidate} THEN 1 ELSE
           CAST(floor(ln(({_hash('0', 'row_id', 'k')} + 1) / {float(16 ** 15)!r}) / ln(1 - {float(n_candidate)} / n)) AS BIGINT) + 1 END AS gap
         FROM l JOIN st USING (g), (SELECT unnest(range(1, {rounds + 1})) AS k)),
pool AS (SELECT row_id, CAST(sum(gap) OVER (PARTITION BY g, row_id ORDER BY k) AS BIGINT) AS round FROM gaps),
lines AS (SELECT l.g, l.row_id, l.orig_len, st.first, nw.ws FROM l JOIN st USING (g) JOIN nw USING (row_id)),
r(g, round, row_id, orig_len, ws, d, chosen, pick) AS (
  SELECT g, CAST(0 AS BIGINT), row_id, orig_len, ws, CAST('inf' AS DOUBLE), row_id = first, first FROM lines
  UNION ALL
  SELECT g, round + 1, row_id, orig_len, ws, d, chosen OR coalesce(row_id = pick, false), pick
  FROM (SELECT *, first_value(CASE WHEN candidate THEN row_id END) OVER (
                    PARTITION BY g ORDER BY candidate DESC, d DESC, orig_len DESC, row_id) AS pick
        FROM (SELECT r.g, r.round, r.row_id, r.orig_len, r.ws, r.chosen, p.row_id IS NOT NULL AND NOT r.chosen AS candidate,
                     CASE WHEN r.pick IS NULL THEN r.d ELSE least(r.d, 1.0::DOUBLE - len(list_intersect(r.ws, q.ws))::DOUBLE
                            / (len(r.ws) + len(q.ws) - len(list_intersect(r.ws, q.ws)))::DOUBLE) END AS d
              FROM r LEFT JOIN nw q ON q.row_id = r.pick LEFT JOIN pool p ON p.row_id = r.row_id AND p.round = r.round + 1))
  WHERE round < {rounds}
),
picks AS (SELECT g, round, any_value(pick) AS row_id FROM r WHERE pick IS NOT NULL GROUP BY g, round),
s AS (SELECT g AS dataset, round, row_id, CAST(row_number() OVER (PARTITION BY g ORDER BY round) AS INTEGER) AS sample_pos FROM picks)
"""


SQL_FARTHEST_SAMPLE = f"""{_farthest_sql('0')}
SELECT shot, sample_pos, row_id FROM s JOIN (SELECT unnest([{_SHOTS}]) AS shot) ON round < shot"""
SQL_FARTHEST_BY_DATASET = f"""{_farthest_sql('role')}
SELECT dataset, shot, sample_pos, row_id FROM s JOIN (SELECT unnest([{_SHOTS}]) AS shot) ON round < shot"""

QUERIES = {
    "hierarchical_sample": (hierarchical_sample, SQL_HIERARCHICAL_SAMPLE),
    "sample_coverage": (sample_coverage, SQL_SAMPLE_COVERAGE),
    "first_share_sample": (first_share_sample, SQL_FIRST_SHARE_SAMPLE),
    "sample_by_dataset": (sample_by_dataset, SQL_SAMPLE_BY_DATASET),
    "mean_coverage": (mean_coverage, SQL_MEAN_COVERAGE),
    "farthest_sample": (farthest_sample, SQL_FARTHEST_SAMPLE),
    "farthest_by_dataset": (farthest_by_dataset, SQL_FARTHEST_BY_DATASET),
}
