"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells (one for each combination of source, language
and topic) with their tokens.  The token weights of the cells are raked: in
turn they are scaled so that the sums by source, by language and by topic meet
the target shares.  A document of a cell is then kept with probability
min(1, c * raked weight / tokens of the cell), where c makes the expected
tokens of the sample the wanted share of all tokens.  The choice for a
document is a hash of its key, so it repeats and needs no state.

Only DataFrame functions run.  The cells are aggregated with partial sums, so
a source with a third of all rows is a few rows for each task; raking works on
the written cell table and never on documents; the documents are joined to the
cells, which are broadcast when their number is within ``BROADCAST_CELLS`` and
joined by a shuffle else.

Targets: for each dimension either shares by value (values without a target
share the rest in proportion to their tokens, or where the shares leave no rest
keep their natural share, and the given ones share what remains; shares of
absent values are spread over the others) or an exponent that flattens the natural shares.

Defined cases: null values are a value of their own; a null or empty text has
no tokens and is kept with the probability of its cell (1 where the cell has
no tokens); rows with equal keys share one fate; an empty table gives no rows;
columns whose names clash with the working columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import guarded, table, written

#: Raking rounds, and rounds between two written tables.
ROUNDS, ROUNDS_AT_A_TIME = 8, 4
#: A rest of the wished shares below this is rounding.
NO_REST = 1e-9
#: Cells up to this number (about 100 bytes each) are broadcast to the documents.
BROADCAST_CELLS = 100_000


def count(text: Column, characters: str) -> Column:
    """How often a text holds these ASCII characters (removing them one by one is faster than translate)."""
    found = F.lit(0)
    for c in characters:
        found = found + F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit("")))
    return found


def words(text: Column) -> Column:
    """White-space characters plus one; 0 for a null or empty text."""
    return F.when(F.octet_length(text) > 0, count(text, " \n\t\r") + 1).otherwise(F.lit(0)).cast("long")


def topic(text: Column) -> Column:
    """A coarse topic by the marks a text holds: table, markup, shout or prose."""
    size = F.length(text)
    return (F.when(50 * count(text, "|") > size, F.lit("table")).when(50 * count(text, "#*$%&<>") > size, F.lit("markup"))
            .when(50 * count(text, "!") > size, F.lit("shout")).otherwise(F.lit("prose")))


def _targets(cells: DataFrame, dim: str, wish) -> DataFrame:
    """(dim, target): shares that sum to 1 over the values present with tokens."""
    shares = cells.groupBy(dim).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    if not isinstance(wish, dict):
        weight = F.pow(F.col("tokens").cast("double"), F.lit(float(wish)))
    else:
        given = F.create_map(*[F.lit(x) for pair in wish.items() for x in (str(pair[0]), float(pair[1]))]) if wish else F.create_map(F.lit(""), F.lit(0.0))
        rest = max(0.0, 1.0 - sum(wish.values()))
        wished = F.element_at(given, F.col(dim).cast("string"))
        x = shares.agg(F.sum(F.when(wished.isNull(), F.col("tokens"))).cast("double").alias("other"), F.sum(F.when(wished.isNotNull(), F.col("tokens"))).cast("double").alias("listed"),
                       F.sum(wished).alias("wished")).first()
        other = x.other or 1.0
        if rest < NO_REST and x.other:  # no rest: their natural share, so that none is lost
            rest = x.wished * x.other / x.listed if x.wished else 1.0
        weight = F.coalesce(wished, F.col("tokens") * rest / other)
    shares = shares.select(dim, weight.alias("target"))
    sum_ = shares.agg(F.sum("target")).first()[0] or 1.0
    return shares.select(dim, (F.col("target") / F.lit(float(sum_))).alias("target"))


def rake(cells: DataFrame, targets: dict) -> DataFrame:
    """``cells`` (dimensions, tokens) with ``weight``: shares of the whole whose sums meet the targets."""
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    out = cells.withColumn("weight", F.col("tokens") / F.lit(float(total)))
    for dim, wish in targets.items():
        target = _targets(cells, dim, wish).select(F.col(dim).alias("_v"), F.col("target").alias(f"_t{dim}"))
        out = out.join(target, F.col(dim).eqNullSafe(F.col("_v")), "left").drop("_v")
    for n in range(1, ROUNDS + 1):
        for dim in targets:
            have = F.sum("weight").over(Window.partitionBy(dim))
            out = out.withColumn("weight", F.when(have > 0, F.col("weight") * (F.coalesce(f"_t{dim}", F.lit(0.0)) / have)).otherwise(F.lit(0.0)))
        if n % ROUNDS_AT_A_TIME == 0 or n == ROUNDS:
            out = written(out, "op3-raked")
    return out.drop(*[f"_t{d}" for d in targets])


def probabilities(cells: DataFrame, share: float) -> DataFrame:
    """``cells`` with ``probability``, so that the expected tokens are ``share`` of all tokens (or
    all tokens of the cells with weight, if those are fewer)."""
    wanted = share * float(cells.agg(F.sum("tokens")).first()[0] or 0)
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(F.lit(0.0))
    cells = cells.withColumn("_ratio", ratio)
    c, capped = 0.0, -1
    while True:  # each pass caps more cells or ends
        full = F.col("_ratio") * F.lit(c) >= 1
        x = cells.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("tokens"), F.sum(F.when(full, 1).otherwise(0)).alias("n"),
                      F.sum(F.when(~full, F.col("weight")).otherwise(0.0)).alias("weight")).first()
        if x.n is None or x.n == capped or not x.weight:
            break
        capped, c = x.n, max(0.0, (wanted - float(x.tokens)) / float(x.weight))
    p = F.least(F.lit(1.0), F.col("_ratio") * F.lit(c))
    return cells.withColumn("probability", F.when(F.col("tokens") > 0, p).otherwise(F.lit(1.0))).drop("_ratio")


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 13 hex digits of md5(seed:key)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16 ** 13))


def mix(docs: DataFrame, targets: dict, share: float, seed: str = "mix", key: str = "doc_id", text: str = "text",
        dims: dict[str, Column] | None = None) -> DataFrame:
    """The sampled rows of ``docs`` with ``_topic``, ``_tokens`` and ``_probability`` beside their own
    columns.  ``targets`` maps dimensions to wishes; a dimension is a column of ``docs`` or an
    expression in ``dims``."""
    dims = dims or {}
    values = {f"_dim{i}": dims.get(d, F.col(d) if d in docs.columns else None) for i, d in enumerate(targets)}
    rows = docs.withColumns({**values, "_tokens": words(F.col(text).cast("string"))})
    names = list(values)
    cells = written(rows.groupBy(*names).agg(F.sum("_tokens").alias("tokens"), F.count("*").alias("documents")), "op3-cells")
    raked = rake(cells, dict(zip(names, targets.values())))
    final = written(probabilities(raked, share), "op3-probabilities")
    few = final.count() <= BROADCAST_CELLS
    looked = final.select(*[F.col(n).alias(f"{n}b") for n in names], F.col("probability").alias("_probability"))
    same = None
    for n in names:
        same = F.col(n).eqNullSafe(F.col(f"{n}b")) if same is None else same & F.col(n).eqNullSafe(F.col(f"{n}b"))
    out = rows.join(F.broadcast(looked) if few else looked, same)
    out = out.where(uniform(F.col(key), seed) < F.col("_probability"))
    return out.drop(*[f"{n}b" for n in names])


#: The production wishes: flatter sources, fixed languages, natural topics a little flatter.
TARGETS = {"source": 0.5, "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}, "topic": 0.8}
SHARE = 0.7


def _mixed(docs: DataFrame) -> DataFrame:
    return mix(docs, TARGETS, SHARE, dims={"topic": topic(F.col("text"))})


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    """Registered query: the sampled documents with their cell and probability."""
    out = _mixed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "lang", F.col("_dim2").alias("topic"), F.col("_tokens").alias("tokens"),
                      F.round("_probability", 6).alias("probability"))


@guarded
def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the sampled documents."""
    return _mixed(docs).select(*docs.columns)


def oracle_sql() -> str:
    """The same sample in DuckDB's SQL, raking unrolled."""
    count = lambda c: f"(length(text) - length(translate(text, '{c}', '')))"
    lang = " ".join(f"WHEN '{k}' THEN {v}" for k, v in TARGETS["lang"].items())
    rest = 1.0 - sum(TARGETS["lang"].values())
    parts = [f"""
d AS (
  SELECT doc_id, source, lang, text,
    CASE WHEN 50 * {count('|')} > length(text) THEN 'table' WHEN 50 * {count('#*$%&<>')} > length(text) THEN 'markup'
         WHEN 50 * {count('!')} > length(text) THEN 'shout' ELSE 'prose' END AS topic,
    CAST(CASE WHEN coalesce(length(text), 0) > 0
      THEN length(text) - length(translate(text, ' ' || chr(10) || chr(9) || chr(13), '')) + 1 ELSE 0 END AS BIGINT) AS tokens
  FROM documents
), c AS (
  SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM d GROUP BY ALL
), t_source AS (
  SELECT source AS v, pow(sum(tokens), {float(TARGETS['source'])}) AS w FROM c GROUP BY 1 HAVING sum(tokens) > 0
), t_topic AS (
  SELECT topic AS v, pow(sum(tokens), {float(TARGETS['topic'])}) AS w FROM c GROUP BY 1 HAVING sum(tokens) > 0
), l AS (
  SELECT lang AS v, sum(tokens) AS n, CASE lang {lang} END AS wish FROM c GROUP BY 1 HAVING sum(tokens) > 0
), t_lang AS (
  SELECT v, coalesce(wish, n * {rest!r} / (SELECT sum(n) FROM l WHERE wish IS NULL)) AS w FROM l
), w0 AS MATERIALIZED (
  SELECT *, tokens / (SELECT sum(tokens) FROM c) AS w FROM c
)"""]
    last = 0
    for _ in range(ROUNDS):
        for dim in ("source", "lang", "topic"):
            parts.append(f"""w{last + 1} AS MATERIALIZED (
  SELECT a.* REPLACE (CASE WHEN h.w > 0 THEN a.w * (t.w / (SELECT sum(w) FROM t_{dim}) / h.w) ELSE 0.0 END AS w)
  FROM w{last} a JOIN (SELECT {dim} AS v, sum(w) AS w FROM w{last} GROUP BY 1) h ON a.{dim} IS NOT DISTINCT FROM h.v
  LEFT JOIN t_{dim} t ON a.{dim} IS NOT DISTINCT FROM t.v
)""")
            last += 1
    parts.append(f"""
f0 AS MATERIALIZED (SELECT *, CASE WHEN tokens > 0 THEN coalesce(w, 0) / tokens ELSE 0 END AS r, 0.0::DOUBLE AS s FROM w{last})""")
    steps = 12
    for n in range(steps):
        parts.append(f"""f{n + 1} AS MATERIALIZED (
  SELECT * REPLACE (coalesce((SELECT greatest(0.0, ({SHARE} * sum(tokens) - sum(CASE WHEN r * s >= 1 THEN tokens ELSE 0 END))
    / nullif(sum(CASE WHEN r * s >= 1 THEN 0.0 ELSE w END), 0)) FROM f{n}), s) AS s) FROM f{n}
)""")
    return "WITH " + ", ".join(parts) + f"""
SELECT d.doc_id, d.source, d.lang, d.topic, d.tokens,
  round(CASE WHEN f.tokens > 0 THEN least(1.0, f.r * f.s) ELSE 1.0 END, 6) AS probability
FROM d JOIN f{steps} f ON d.source IS NOT DISTINCT FROM f.source AND d.lang IS NOT DISTINCT FROM f.lang AND d.topic = f.topic
WHERE ('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT / {float(16 ** 13)!r}
  < CASE WHEN f.tokens > 0 THEN least(1.0, f.r * f.s) ELSE 1.0 END
"""
