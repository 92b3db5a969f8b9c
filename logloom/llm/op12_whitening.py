"""Embedding whitening by weighted multiplicity covariance.

Components c become the integers x = floor(SCALE * c) + OFFSET, so equal
vectors are equal bytes.  Then:

1. identical x vectors are grouped (partially aggregated, so a vector in a third
   of all rows is one row for each task) and written once, with their counts;
2. the sums of the fit are exact integers; the fit weight of a distinct vector is its
   count, or one (``weights``);
3. covariance by a weighted centred matrix product for each partition: the
   exact mean S / n is taken off before multiplying, its whole part in integers and the
   rest in floating point, so a large offset costs no digits.  dim x dim sums are added by
   a shuffle, and only their total reaches the driver (8 KB for 32 dimensions, 8 MB for
   1,024; it doesn't grow with the rows);
4. the eigenvectors of the total project each distinct vector once;
5. a second weighted product over the projected vectors measures how far their
   covariance is from the identity;
6. the rows join the whitened vectors by a 256-bit hash of x.

Nothing but per-dimension sums and two matrices reaches the driver.

Defined cases: rows whose vector is null or holds null or non-finite entries
take no part, nor do rows with an entry whose x isn't a 64-bit integer; shorter
vectors count as padded with c = 0; rows that repeat a vector or an id each get
their own results; a null id stays null; components without variance (an
eigenvalue below the rounding of the largest) are left out, so a table of one
distinct vector, of none, or of vectors without entries gives no rows; equal
eigenvalues have eigenvectors of the library's choice; a deviation beyond a
64-bit integer is null; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, table, written

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Vectors that a task has as floating point numbers at once.
VECTORS_AT_A_TIME = 2048
#: Integers up to this size, and their products' sums, are added without overflow in 64 bits.
SAFE = 1 << 62


def integers(values: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(which, x): the numbers of the vectors that take part, and their x as an array of int64."""
    n = len(values)
    whole = np.asarray(values.is_valid())
    lengths = np.where(whole, pc.list_value_length(values).fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    flat = pc.cast(values.flatten(), pa.float64()).to_numpy(zero_copy_only=False)  # null entries become NaN
    row = np.repeat(np.arange(n), lengths)
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(SCALE * flat)
        fits = np.abs(scaled) < 2.0 ** 63 - 2 * OFFSET  # false for NaN
    whole = whole.copy()
    whole[row[~fits]] = False
    x = np.full((n, dim), OFFSET, dtype=np.int64)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    kept = whole[row]
    x[row[kept], place[kept]] = scaled[kept].astype(np.int64) + OFFSET
    which = np.flatnonzero(whole)
    return which, x[which]


def _vectors(rows: DataFrame, vector: str, dim: int, *keep: str) -> DataFrame:
    """The columns ``keep``, and x as bytes, of the rows that take part."""
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, x = integers(column(batch, vector), dim)
            data = x.astype("<i8").tobytes()
            step = 8 * dim
            some = batch.take(pa.array(which))
            yield pa.RecordBatch.from_arrays(
                [*(column(some, c) for c in keep), pa.array([data[i:i + step] for i in range(0, len(data), step)], pa.binary())], names=[*keep, "x"])

    return rows.select(*keep, vector).mapInArrow(run, f"{kinds}{', ' if keep else ''}x binary")


def _blocks(batches: Iterator[pa.RecordBatch], name: str, dtype: str, dim: int, *more: str):
    """(matrix, columns ``more``) of some rows at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, VECTORS_AT_A_TIME):
            part = batch.slice(lo, VECTORS_AT_A_TIME)
            x = np.frombuffer(b"".join(column(part, name).to_pylist()), dtype).reshape(part.num_rows, dim)
            yield (x, *(column(part, c).to_numpy() for c in more))


def _integer_sums(distinct: DataFrame, dim: int) -> tuple[int, list[int]]:
    """(n, S): the total weight and the exact sums by dimension of weight * x."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dim
        for x, w in _blocks(batches, "x", "<i8", dim, "weight"):
            n += int(w.sum())
            if float(np.abs(x).max(initial=0)) * float(w.sum()) < SAFE:
                part = (x * w[:, None]).sum(0).tolist()
            else:
                part = (x.astype(object) * w.astype(object)[:, None]).sum(0).tolist()
            sums = [a + b for a, b in zip(sums, part)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, dim), pa.int32()), pa.array([str(v) for v in (n, *sums)])], names=["d", "s"])

    rows = distinct.select("x", "weight").mapInArrow(run, "d int, s string")
    found = rows.groupBy("d").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # a row a dimension
    sums = {r.d: int(r.s) for r in found}
    return sums.get(-1, 0), [sums.get(d, 0) for d in range(dim)]


def _total(parts: DataFrame, dim: int) -> np.ndarray:
    """The sum of symmetric matrices given as (i, j, v), i <= j."""
    out = np.zeros((dim, dim))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # dim x dim rows
        out[r.i, r.j] = out[r.j, r.i] = r.v
    return out


def _upper(m: np.ndarray) -> pa.RecordBatch:
    i, j = np.triu_indices(len(m))
    return pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(m[i, j])], names=["i", "j", "v"])


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n in double precision: whole parts as integers, then the rest."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([(s % n) / n for s in sums])
    if float(np.abs(x).max(initial=0)) + float(np.abs(whole).max(initial=0)) < SAFE:
        return (x - whole).astype(float) - rest
    return (x.astype(object) - whole.astype(object)).astype(float) - rest


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over the dimensions of (n * x - S)^2, exactly; null beyond 64 bits."""
    far = max((abs(n * int(v) - s) for v, s in zip((*x.max(0), *x.min(0)), (*sums, *sums))), default=0) if len(x) else 0
    if len(sums) * far * far < SAFE and float(np.abs(x).max(initial=0)) * n < SAFE:
        gap = n * x - np.array(sums, dtype=np.int64)
        return (gap * gap).sum(1).tolist()
    gap = n * x.astype(object) - np.array(sums, dtype=object)
    return [v if v < 1 << 63 else None for v in (gap * gap).sum(1).tolist()]


def whitened(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, weights: str = "one") -> DataFrame:
    """key, n, deviation, whitened and explained (arrays by component), identity_error of every row that takes part.

    ``weights``: ``one`` fits every distinct vector once, ``count`` as often as it occurs."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    kind = rows.schema["key"].dataType.simpleString()
    empty = spark.createDataFrame([], f"key {kind}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double")
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 0
    if dim <= 0:
        return empty
    weight = F.count("*") if weights == "count" else F.max(F.lit(1)).cast("long")
    distinct = written(_vectors(rows.select("v"), "v", dim).groupBy("x").agg(weight.alias("weight")), "op12-distinct")
    n, sums = _integer_sums(distinct, dim)
    if not n:
        return empty

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for x, w in _blocks(batches, "x", "<i8", dim, "weight"):
            d = centred(x, n, sums)
            total += (d * w[:, None]).T @ d
        yield _upper(total)

    covariance = _total(distinct.select("x", "weight").mapInArrow(products, "i int, j int, v double"), dim) / n
    values, directions = np.linalg.eigh(covariance)
    trace = float(np.trace(covariance))
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > dim * np.finfo(float).eps * max(values.max(), 0)]
    if not len(order):
        return empty
    size, used = len(order), values[order]
    turned = directions[:, order] / np.sqrt(used)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, VECTORS_AT_A_TIME):
                part = batch.slice(lo, VECTORS_AT_A_TIME)
                x = np.frombuffer(b"".join(column(part, "x").to_pylist()), "<i8").reshape(part.num_rows, dim)
                y = np.ascontiguousarray(centred(x, n, sums) @ turned)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, size, dtype=np.int32)), pa.array(y.reshape(-1)))
                yield pa.RecordBatch.from_arrays([column(part, "h"), column(part, "weight"), pa.array(deviations(x, n, sums), pa.int64()), lists],
                                                 names=["h", "weight", "deviation", "whitened"])

    hashed = F.unhex(F.sha2("x", 256))
    once = distinct.select(hashed.alias("h"), "x", "weight").mapInArrow(project, "h binary, weight long, deviation long, whitened array<double>")
    once = written(once, "op12-whitened")

    means = once.select("weight", F.posexplode("whitened").alias("c", "y")).groupBy("c").agg((F.sum(F.col("weight") * F.col("y")) / n).alias("m")).collect()
    mean = np.zeros(size)
    for r in means:  # a row a component
        mean[r.c] = r.m

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            y = column(batch, "whitened").flatten().to_numpy().reshape(batch.num_rows, size) - mean
            total += (y * column(batch, "weight").to_numpy()[:, None]).T @ y
        yield _upper(total)

    error = float(np.abs(_total(once.select("weight", "whitened").mapInArrow(check, "i int, j int, v double"), size) / n - np.eye(size)).max())
    back = _vectors(rows, "v", dim, "key").select("key", hashed.alias("h"))
    out = back.join(once.drop("weight"), "h")
    return out.select("key", F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                      F.array(*[F.lit(float(v) / trace) for v in used]).alias("explained"), F.lit(error).alias("identity_error"))


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    """Registered query: every row of ``embeddings`` that takes part, by component."""
    found = whitened(table(spark, sf_dir, "embeddings"))
    parts = found.select(F.col("key").alias("vec_id"), "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("c", "whitened"))
    return parts.select("vec_id", (F.col("c") + 1).alias("component"), "n", "deviation", "whitened",
                        F.col("explained")[F.col("c")].alias("explained"), "identity_error")
