"""Language identification by nearest centroids.

A text becomes a vector of hashed character n-grams (one to three letters,
word borders included), weighted by damped term frequency and inverse
document frequency and scaled to length one.  Document frequencies are
counted over every learning document.  For each language, spherical k-means
makes several centroids from about ``PER_LANGUAGE`` documents chosen by hash
of the key.  A text gets the language of the centroid with the largest
cosine; it is marked as rejected when it is farther away than nearly all
learning documents of that language are from theirs.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
so is every text when nothing can be learnt.  Equal cosines go to the language
that sorts first.  Rows with a null language are never learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, column, held_out, slices

DIMENSIONS = 1 << 13
#: Documents of each language that centroids are made from (expected; twice as many at most).
PER_LANGUAGE = 1000
CENTROIDS, ROUNDS = 4, 12
#: Share of learning documents that the rejection distance leaves outside.
OUTSIDE = 0.01
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(1 << 16)])


def grams(text: str | None) -> np.ndarray | None:
    """The hashed n-grams of a text (one entry for each occurrence); None without a letter."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)
    letter = _letters()[np.minimum(codes, 0xFFFF)]
    if len(far := np.flatnonzero(codes > 0xFFFF)):
        letter = letter.copy()
        letter[far] = [chr(c).isalpha() for c in codes[far]]
    if not letter.any():
        return None
    codes = np.where(letter, codes, 32)
    codes = np.concatenate(([32], codes, [32])).astype(np.uint64)
    codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]
    one = codes * _A
    two = one[:-1] ^ (codes[1:] * _B)
    three = two[:-1] ^ (codes[2:] * _C)
    every = np.concatenate((one[codes != 32], two, three))
    every = (every ^ (every >> np.uint64(29))) * _B
    return (every >> np.uint64(64 - 13)).astype(np.int64)


def vector(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    counts = np.bincount(found, minlength=DIMENSIONS)
    v = np.zeros(DIMENSIONS, dtype=np.float32)
    at = np.flatnonzero(counts)
    v[at] = (1 + np.log(counts[at])) * idf[at]
    norm = float(np.sqrt(np.dot(v, v)))
    return v / norm if norm else v


def document_frequencies(docs: DataFrame, text: str = "t") -> tuple[np.ndarray, int]:
    """For each dimension the documents that have it, and the number of documents with a letter.
    A task sends one row for each dimension, so the result is bounded."""
    out = pa.schema([("d", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMENSIONS + 1, dtype=np.int64)
        for batch in slices(batches, text):
            for t in column(batch, text).to_pylist():
                found = grams(t)
                if found is not None:
                    total[:DIMENSIONS] += np.bincount(found, minlength=DIMENSIONS) > 0
                    total[DIMENSIONS] += 1
        at = np.flatnonzero(total)
        yield batch_of(out, [at.astype(np.int32), total[at]])

    rows = docs.select(text).mapInArrow(run, "d int, n long").groupBy("d").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(DIMENSIONS + 1, dtype=np.int64)
    for r in rows:
        total[r.d] = r.n
    return total[:DIMENSIONS], int(total[DIMENSIONS])


def cluster(x: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means; the first centres are the mean's nearest row, then the rows farthest from all before."""
    mean = x.mean(axis=0)
    centres = [x[int(np.argmax(x @ mean))]]
    while len(centres) < min(k, len(x)):
        near = np.max(x @ np.stack(centres).T, axis=1)
        centres.append(x[int(np.argmin(near))])
    c = np.stack(centres)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        for j in range(len(c)):
            if (own == j).any():
                m = x[own == j].sum(axis=0)
                c[j] = m / max(float(np.linalg.norm(m)), 1e-12)
    return c


class Model:
    def __init__(self, idf: np.ndarray, languages: list[str], of: np.ndarray, centroids: np.ndarray, least: np.ndarray):
        self.idf, self.languages, self.of, self.centroids, self.least = idf, languages, of, centroids, least


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learn from the documents with a language outside the held-out fold."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(key)))
    rows = rows.select(F.col(key).cast("long").alias("k"), F.col(lang).cast("string").alias("l"), F.col(text).cast("string").alias("t"))
    df, n = document_frequencies(rows)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    # a hash of the key below PER_LANGUAGE / documents of the language; no group of a language is ever sorted
    sizes = rows.groupBy("l").agg(F.count("*").alias("n"))
    share = F.pmod(F.xxhash64("k"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chosen = rows.select("k", "l").join(sizes, "l").where(share * F.col("n") < PER_LANGUAGE).select("k", "l").distinct()
    out = pa.schema([("l", pa.string()), ("k", pa.int64()), ("at", pa.list_(pa.int32())), ("w", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            some = [(l, k, vector(g, idf)) for l, k, t in zip(*(column(batch, c).to_pylist() for c in "lkt"))
                    if (g := grams(t)) is not None]
            if some:
                at = [np.flatnonzero(v).astype(np.int32) for _, _, v in some]
                yield batch_of(out, [[s[0] for s in some], [s[1] for s in some], at, [s[2][a] for s, a in zip(some, at)]])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k", kind="stable").head(2 * PER_LANGUAGE)
        x = np.zeros((len(pdf), DIMENSIONS), dtype=np.float32)
        for i, (at, w) in enumerate(zip(pdf["at"], pdf["w"])):
            x[i, at] = w
        c = cluster(x)
        least = float(np.quantile(np.max(x @ c.T, axis=1), OUTSIDE))
        return pd.DataFrame({"l": pdf["l"].iloc[0], "j": range(len(c)), "c": [list(map(float, v)) for v in c], "least": least})

    rows = rows.join(F.broadcast(chosen), ["k", "l"], "left_semi")  # about PER_LANGUAGE rows a language
    picked = rows.mapInArrow(run, "l string, k long, at array<int>, w array<float>")
    picked = picked.groupBy("l", "k").agg(F.min(F.struct("at", "w")).alias("v")).select("l", "k", "v.at", "v.w")  # repeated keys
    found = picked.groupBy("l").applyInPandas(fit, "l string, j int, c array<float>, least double").collect()
    found.sort(key=lambda r: (r.l, r.j))
    languages = sorted({r.l for r in found})
    place = {l: i for i, l in enumerate(languages)}
    return Model(idf, languages, np.array([place[r.l] for r in found], dtype=int),
                 np.array([r.c for r in found], dtype=np.float32).reshape(-1, DIMENSIONS), np.array([r.least for r in found]))


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score (the cosine) and rejected of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x centroids x dimensions
    out = pa.schema([(key, pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, "_text"):
            found = [grams(t) for t in column(batch, "_text").to_pylist()]
            lang, score = ["und"] * len(found), np.zeros(len(found))
            rejected = np.ones(len(found), dtype=bool)
            some = [i for i, g in enumerate(found) if g is not None] if m.languages else []
            if some:
                cos = np.stack([vector(found[i], m.idf) for i in some]) @ m.centroids.T
                best = np.argmax(cos, axis=1)  # the first of equal ones; centroids are in order of language
                for i, j, c in zip(some, best, cos[np.arange(len(some)), best]):
                    lang[i], score[i], rejected[i] = m.languages[m.of[j]], min(1.0, max(0.0, float(c))), bool(c < m.least[j])
            yield batch_of(out, [column(batch, key), lang, score, rejected])

    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"`{key}` long, lang_pred string, score double, rejected boolean")


def op9_language(spark, sf_dir: str) -> DataFrame:
    """Registered query: predicted language of every document."""
    from .common import table
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
