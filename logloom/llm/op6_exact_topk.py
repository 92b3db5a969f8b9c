"""Exact top-k search by inner product as a Voronoi kNN join.

Components become floor(256 * x).  One more component, sqrt(M^2 - |s|^2) for
data (M the largest norm) and 0 for queries, turns the inner product into a
distance: |q' - s'|^2 = |q|^2 + M^2 - 2 q.s.  Then:

1. a bounded number of pivots is drawn from the data by hash of the id; each
   vector belongs to the cell of its nearest pivot;
2. summaries of the cells (size, largest distance, the k + 1 smallest distances
   to the pivot) and of the query groups (size, largest distance) go to the
   driver: pivots x (k + 1) rows;
3. the triangle inequality over the summaries bounds the distance of the k-th
   neighbour of each query group, and so the least distance to its own pivot
   that a data vector of each cell must have to matter to the group;
4. only those data vectors are replicated to the group, spread over blocks;
   groups are split into teams of at most ``TEAM`` queries;
5. every (team, block) is solved by a matrix product, and the best k of the
   blocks are merged.

All products are integers below 2^53 (checked), so scores are exact.

Defined cases: null vectors, vectors with null or non-finite components and
rows without id take no part; shorter vectors count as padded with zeros; rows
that repeat id and vector count once; of rows with equal ids none is a
candidate of another, each is a query; equal scores go to the smaller id; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, column, table, written

MAX_PIVOTS = 256
QUERIES_PER_PIVOT = 64
TEAM = 2048
BLOCK = 32_768
#: Room for rounding in the distance bounds, as a share of the largest distance.
SLACK = 1e-9


def _matrix(values: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(whole, matrix): which vectors have only finite components, and floor(256 * x), padded with zeros."""
    n = len(values)
    whole = np.asarray(values.is_valid())
    flat = values.flatten()
    lengths = np.where(whole, np.nan_to_num(np.asarray(pc.list_value_length(values).to_numpy(zero_copy_only=False), dtype=float)), 0).astype(np.int64)
    x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(n), lengths)
    whole[row[~np.isfinite(x)]] = False
    out = np.zeros((n, dim))
    place = np.arange(len(x)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, place] = np.floor(256 * np.where(np.isfinite(x), x, 0))
    return whole, out


def _distances(x: np.ndarray, last: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows (with their additional component) to the pivots."""
    square = ((x * x).sum(1) + last * last)[:, None] + (pivots * pivots).sum(1) - 2 * (x @ pivots[:, :-1].T + last[:, None] * pivots[:, -1])
    return np.sqrt(np.maximum(square, 0))


def top_k(vectors: DataFrame, k: int, is_query, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for every row where ``is_query`` (a Column) holds, the k other
    rows with the largest integer inner product."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(
        F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 0

    def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, x = _matrix(column(batch, "v"), dim)
            at = np.flatnonzero(whole)
            if (np.abs(x[at]) >= 2.0 ** 31).any():
                raise ValueError("components beyond 2^23 can't be scored exactly")
            kept = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays(
                [column(kept, "id"), column(kept, "q"), pa.array([r.tobytes() for r in x[at].astype("<i4")], pa.binary()),
                 pa.array((x[at] ** 2).sum(1))], names=["id", "q", "v", "n2"])

    whole = rows.mapInArrow(integers, "id long, q boolean, v binary, n2 double").dropDuplicates(["id", "v"])
    whole = written(whole, "op6-vectors")
    facts = whole.agg(F.max("n2").alias("m2"), F.count("*").alias("n"), F.sum(F.col("q").cast("long")).alias("queries")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not facts.n or not facts.queries:
        return empty
    m2 = float(facts.m2)
    if m2 >= 2.0 ** 53:
        raise ValueError("inner products beyond 2^53 can't be scored exactly")
    wanted = max(1, min(MAX_PIVOTS, facts.queries // QUERIES_PER_PIVOT))
    drawn = whole.select("id", "v", "n2").orderBy(F.xxhash64("id", F.lit(6)), "id", "v").limit(wanted).collect()
    px = np.stack([np.frombuffer(r.v, "<i4").astype(float) for r in drawn])
    pivots = np.concatenate([px, np.sqrt(np.maximum(m2 - (px * px).sum(1), 0))[:, None]], axis=1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = column(batch, "v")
            x = np.frombuffer(b"".join(v.to_pylist()), "<i4").reshape(len(v), dim).astype(float)
            ds = _distances(x, np.sqrt(np.maximum(m2 - (x * x).sum(1), 0)), pivots)
            dq = _distances(x, np.zeros(len(x)), pivots)
            cs, cq = ds.argmin(1), dq.argmin(1)
            at = np.arange(len(x))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "id"), column(batch, "q"), v, pa.array(cs.astype(np.int32)), pa.array(ds[at, cs]),
                 pa.array(cq.astype(np.int32)), pa.array(dq[at, cq])], names=["id", "q", "v", "cs", "ds", "cq", "dq"])

    placed = whole.select("id", "q", "v").mapInArrow(assign, "id long, q boolean, v binary, cs int, ds double, cq int, dq double")
    placed = written(placed, "op6-cells")
    near = Window.partitionBy("cs").orderBy("ds", "id")
    least = placed.groupBy("cs", "id").agg(F.min("ds").alias("ds")).withColumn("r", F.row_number().over(near)).where(F.col("r") <= k + 1).collect()
    cells = {r.cs: r for r in placed.groupBy("cs").agg(F.count("*").alias("n"), F.max("ds").alias("far")).collect()}
    groups = {r.cq: r for r in placed.where("q").groupBy("cq").agg(F.count("*").alias("n"), F.max("dq").alias("far")).collect()}

    between = _distances(pivots[:, :-1], pivots[:, -1], pivots)
    slack = SLACK * (2 * np.sqrt(m2) + 1)
    teams = []  # (group, team of the group, least distance by cell, blocks)
    for g, group in sorted(groups.items()):
        bounds, seen, theta = sorted((group.far + between[g, r.cs] + r.ds, r.id) for r in least), set(), np.inf
        for bound, other in bounds:
            seen.add(other)
            if len(seen) == k + 1:
                theta = bound
                break
        floor = np.array([between[g, c] - group.far - theta - slack for c in range(len(pivots))])
        reached = sum(c.n for j, c in cells.items() if c.far >= floor[j])
        for t in range(-(-group.n // TEAM)):
            teams.append((g, t, floor, max(1, -(-reached // BLOCK))))
    size = {g: -(-r.n // TEAM) for g, r in groups.items()}
    blocks = {g: b for g, _, _, b in teams}
    floors = np.stack([t[2] for t in teams])
    first = {}
    for i, (g, _, _, _) in enumerate(teams):
        first.setdefault(g, i)
    team_blocks = np.array([t[3] for t in teams])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("team", pa.int32()), ("block", pa.int32()), ("id", pa.int64()), ("v", pa.binary())])
        for batch in batches:
            made = [], [], [], []
            for i, g, v in zip(column(batch, "id").to_pylist(), column(batch, "cq").to_pylist(), column(batch, "v").to_pylist()):
                team = first[g] + (i // 50 + i) % size[g]
                for b in range(blocks[g]):
                    for c, x in zip(made, (team, b, i, v)):
                        c.append(x)
            yield batch_of(out, list(made))

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ds, cs = column(batch, "ds").to_numpy(), column(batch, "cs").to_numpy()
            ids = column(batch, "id").to_numpy()
            for t in range(len(teams)):
                at = np.flatnonzero(ds >= floors[t, cs])
                if len(at):
                    kept = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), t, dtype=np.int32)), pa.array((ids[at] % team_blocks[t]).astype(np.int32)),
                         column(kept, "id"), column(kept, "v")], names=["team", "block", "id", "v"])

    def solve(asked: pa.Table, offered: pa.Table) -> pa.Table:
        out = pa.schema([("query_id", pa.int64()), ("v", pa.binary()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not asked.num_rows or not offered.num_rows:
            return out.empty_table()
        ids, qv = asked.column("id").to_numpy(), asked.column("v").to_pylist()
        s_ids = offered.column("id").to_numpy()
        s = np.frombuffer(b"".join(offered.column("v").to_pylist()), "<i4").reshape(len(s_ids), dim).astype(float)
        order = np.argsort(s_ids, kind="stable")
        s_ids, s = s_ids[order], s[order]
        made = []
        for lo in range(0, len(ids), 128):
            q = np.frombuffer(b"".join(qv[lo:lo + 128]), "<i4").reshape(-1, dim).astype(float)
            scores = q @ s.T
            scores[ids[lo:lo + 128][:, None] == s_ids] = -np.inf
            for i, line in enumerate(scores):
                least = np.partition(line, -k)[-k] if len(line) > k else -np.inf
                at = np.flatnonzero((line >= least) & (line > -np.inf))
                at = at[np.argsort(-line[at], kind="stable")][:k]  # ids ascend among equal scores
                made += [(int(ids[lo + i]), qv[lo + i], int(s_ids[j]), int(line[j])) for j in at]
        return pa.Table.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*made), out)], schema=out) if made else out.empty_table()

    schema = "team int, block int, id long, v binary"
    asked = placed.where("q").select("id", "cq", "v").mapInArrow(ask, schema).groupBy("team", "block")
    offered = placed.select("id", "cs", "ds", "v").mapInArrow(offer, schema).groupBy("team", "block")
    best = asked.cogroup(offered).applyInArrow(solve, "query_id long, v binary, vec_id long, score long")
    order = Window.partitionBy("query_id", "v").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op6_exact_topk(spark, sf_dir: str) -> DataFrame:
    """Registered query: the 5 best of every vector whose id is divisible by 50."""
    return top_k(table(spark, sf_dir, "embeddings"), 5, F.col("vec_id") % 50 == 0)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
