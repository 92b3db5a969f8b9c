"""Log-shaped inputs rendered from the given tables.

None of the test tables hold log lines, so ``events`` is rendered into one
log line per event with plain ``concat``/``CASE`` expressions.  The same SQL
text runs in Spark and in DuckDB, so an oracle can rebuild the input without
sharing any of the parsing code.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

EVENTS_FORMAT = "<Date> <Time> <Level> <Component>: <Content>"

# SELECT list over `events` (portable between Spark SQL and DuckDB).
_K = "regexp_extract(props, '[0-9]+', 0)"
_V = "cast(cast(value as decimal(10,2)) as string)"
RENDER_COLUMNS = [
    "'events' AS dataset",
    "event_id + 1 AS LineId",
    "event_type",
    "cast(cast(ts as date) as string) AS Date",
    "substr(cast(ts as string), 12, 8) AS Time",
    "CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS Level",
    "'app.' || event_type AS Component",
    f"""CASE
    WHEN event_type = 'purchase' THEN 'user ' || cast(user_id as string) || ' bought item blk_' || cast(event_id as string)
         || ' for ' || {_V} || ' usd from 10.0.' || cast(user_id % 200 as string) || '.' || {_K}
    WHEN event_type = 'click' AND event_id % 2 = 0 THEN 'click on button (id=' || {_K} || ') by user ' || cast(user_id as string) || ' state on'
    WHEN event_type = 'click' THEN 'click on button (id=' || {_K} || ') by user ' || cast(user_id as string) || ' state off'
    WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'request ' || cast(event_id as string) || ' failed: timeout after ' || {_K} || ' ms'
    WHEN event_type = 'error' THEN 'request ' || cast(event_id as string) || ' failed: connection reset by 10.0.0.' || {_K}
    WHEN event_type = 'view' THEN 'view page /p/' || {_K} || ' status 200'
    WHEN event_type = 'signup' THEN 'new session opened'
    ELSE 'unknown event ' || event_type
  END AS Content""",
    """CASE
    WHEN event_type = 'purchase' THEN 'user <*> bought item <*> for <*> usd from <*>'
    WHEN event_type = 'click' THEN 'click on button (id=<*>) by user <*> state <*>'
    WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'request <*> failed: timeout after <*> ms'
    WHEN event_type = 'error' THEN 'request <*> failed: connection reset by <*>'
    WHEN event_type = 'view' THEN 'view page <*> status <*>'
    WHEN event_type = 'signup' THEN 'new session opened'
    ELSE 'unknown event ' || event_type
  END AS gt""",
    """CASE
    WHEN event_type = 'purchase' THEN 'user <*> bought item <*> for <*> usd from <*>'
    WHEN event_type = 'click' AND event_id % 2 = 0 THEN 'click on button (id=<*>) by user <*> state on'
    WHEN event_type = 'click' THEN 'click on button (id=<*>) by user <*> state off'
    WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'request <*> failed: timeout after <*> ms'
    WHEN event_type = 'error' THEN 'request <*> failed: connection reset by <*>'
    WHEN event_type = 'view' THEN 'view page /p/<*> status <*>'
    WHEN event_type = 'signup' THEN 'new session opened'
    ELSE 'unknown event ' || event_type
  END AS expected""",
]
RENDER_SELECT = ",\n  ".join(RENDER_COLUMNS)

# DuckDB/Spark SQL for the rendered table (with the raw line).
RENDERED_SQL = f"""
  SELECT r.*, r.Date || ' ' || r.Time || ' ' || r.Level || ' ' || r.Component || ': ' || r.Content AS raw
  FROM (SELECT {RENDER_SELECT} FROM events) r
"""


def table(spark: SparkSession, sf_dir: str, name: str, columns=None) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df


def rendered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered log table: dataset, LineId, event_type, header columns,
    Content, gt (truth template), expected (template without a model), raw."""
    ev = table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value", "props"])
    ev = ev.withColumn("ts", ev["ts"].cast("timestamp_ntz"))
    r = ev.selectExpr(*RENDER_COLUMNS)
    return r.selectExpr("*", "Date || ' ' || Time || ' ' || Level || ' ' || Component || ': ' || Content AS raw")


def raw_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw text lines (``value``) of the rendered table, with the line number."""
    return rendered_events(spark, sf_dir).selectExpr("LineId", "raw AS value")


# A second rendering of `events`, with more kinds of variables: MAC addresses, hex groups, quoted
# commands, # chains, booleans, one-word lines, placeholders, leading variables, and literal lines
# that a later, more general template also covers.  `rule` is the template of the clean-up rules,
# `gt` the truth (NULL on lines that nobody labelled).
_WHO = "CASE WHEN user_id % 97 = 0 THEN cast(user_id as string) ELSE 'w' || cast(user_id % 40 as string) END"
_MAC = "'0a:1b:2c:3d:4e:' || cast(10 + user_id % 90 as string)"
_KIND = "event_id % 12"


def _cases(values: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN {_KIND} = {i} THEN {v}" for i, v in enumerate(values)) + " END"


VARIED_COLUMNS = [
    "'sys' || cast(event_id % 3 as string) AS dataset",
    "event_id + 1 AS LineId",
    _cases([f"'worker ' || {_WHO} || ' finished job ' || {_K}",
            f"'link ' || {_MAC} || ' is up'",
            "'dump DEAD BEEF ' || cast(1000 + user_id as string) || ' 4567 end'",
            f"'executed cmd \"ls -l /tmp/' || {_K} || '\"'",
            f"'pool #' || {_K} || '#' || cast(user_id as string) || '# ready'",
            "'flag ' || CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END || ' set by root'",
            "'heartbeat'",
            "'hello {name} from 10.1.2.' || cast(user_id % 200 as string)",
            "'open /var/log/x' || cast(user_id % 50 as string) || '.txt failed'",
            "cast(user_id as string) || ' users online'",
            f"'cache size=' || {_K} || ' kB (hits=' || cast(user_id as string) || ')'",
            f"'worker ' || {_WHO} || ' finished job final'"]) + " AS Content",
    _cases(["'worker <*> finished job <*>'", "'link <*> is up'", "'dump <*> end'", "'executed cmd <*>'", "'pool <*> ready'",
            "'flag <*> set by <*>'", "'heartbeat'", "'hello <*> from <*>'", "'open <*> failed'", "cast(NULL as string)",
            "'cache size=<*> kB (hits=<*>)'", "'worker <*> finished job <*>'"]) + " AS gt",
    _cases(["'worker ' || CASE WHEN user_id % 97 = 0 THEN '<*>' ELSE 'w' || cast(user_id % 40 as string) END || ' finished job <*>'",
            "'link <*> is up'", "'dump <*> end'", "'executed cmd <*>'", "'pool #<*># ready'",
            "'flag ' || CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END || ' set by root'", "'heartbeat'", "'hello <*> from <*>'",
            "'open /var/log/x' || cast(user_id % 50 as string) || '.txt failed'", "'<*> users online'", "'cache size=<*> kB (hits=<*>)'",
            "'worker ' || CASE WHEN user_id % 97 = 0 THEN '<*>' ELSE 'w' || cast(user_id % 40 as string) END || ' finished job final'"]) + " AS rule",
]
VARIED_SQL = "SELECT " + ",\n  ".join(VARIED_COLUMNS) + " FROM events"


def varied_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The varied log: dataset, LineId, Content, gt, rule."""
    return table(spark, sf_dir, "events", ["event_id", "user_id", "props"]).selectExpr(*VARIED_COLUMNS)
