"""Toxicity by the nearest labelled examples.

Examples are at most ``EXAMPLES`` labelled rows of the learning fold, chosen
by hash of the key.  Terms are lower-cased words and their first
four letters; the vocabulary holds the terms whose presence in an example
depends most on its label (chi-square, at most ``VOCABULARY`` terms).  Inverse
document frequencies are counted over all documents.  A text's neighbours are
its ``NEIGHBOURS`` examples with the largest cosine of TF-IDF vectors over the
vocabulary, ties to the smaller key, found exactly in a block-max inverted
index: examples lie in blocks, each term knows its largest weight in each
block, and blocks are opened in order of their upper bound until no bound
reaches the last neighbour.

Neighbours vote with weight (1 - distance)^2 / (distance + 0.05).  A logistic curve fitted to
the leave-one-out votes of the examples turns a vote into a probability; a
text that shares no term with any example gets the share of toxic examples
among the examples of that kind.  The nearest examples are the evidence.

Index and vocabulary are bounded by the two parameters; they are the only data
sent to every task.

Defined cases: a null or empty text has no neighbours; labels that contradict
each other for a key are not learnt from; without labels every score is 0;
repeated rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, column, guarded, held_out, slices, table
from .memory import forget

#: Labelled rows that serve as examples, at most.
EXAMPLES = 8192
#: Terms of the vocabulary, at most.
VOCABULARY = 4096
#: Least chi-square of a term, and examples that hold it.
LEAST_CHI2 = 20.0
LEAST_EXAMPLES = 5
NEIGHBOURS = 15
BLOCK = 128
FIRST_BLOCKS = 4
FAR_WEIGHT = 0.1
#: Answers a worker remembers for vectors that repeat.
ANSWERS_KEPT = 20_000
#: Lengths of the word beginnings that are terms.
STEMS = (4,)
#: Documents with a score from here on are predicted toxic.
THRESHOLD = 0.3

_WORD = re.compile(r"[^\W\d_]+")


def terms(text: str | None) -> Counter:
    """Words and stems of a text with their counts."""
    if not text:
        return Counter()
    found: Counter = Counter()
    for word, n in Counter(_WORD.findall(text.lower())).items():
        found[word] += n
        for k in STEMS:
            if len(word) > k:
                found[word[:k] + "*"] += n
    return found


class Index:
    """Block-max inverted index of the examples."""

    def __init__(self, vocabulary: list[str], idf: np.ndarray, keys: list[int], labels: list[int],
                 vectors: list[tuple[np.ndarray, np.ndarray]]):
        self.place = {t: i for i, t in enumerate(vocabulary)}
        self.stems = {t[:-1]: i for t, i in self.place.items() if t.endswith("*")}
        self.idf = idf
        heaviest = [int(at[np.argmax(w)]) if len(at) else -1 for at, w in vectors]
        order = sorted(range(len(keys)), key=lambda i: (heaviest[i], labels[i], keys[i]))  # alike ones share blocks
        self.keys = np.array([keys[i] for i in order], dtype=np.int64)
        self.labels = np.array([labels[i] for i in order], dtype=np.int64)
        self.blocks = max(1, -(-len(keys) // BLOCK))
        term = np.concatenate([vectors[i][0] for i in order] or [np.empty(0, int)]).astype(np.int64)
        weight = np.concatenate([vectors[i][1] for i in order] or [np.empty(0)])
        row = np.repeat(np.arange(len(order)), [len(vectors[i][0]) for i in order])
        by = np.lexsort((row, term))
        term, self.row, self.weight = term[by], row[by], weight[by]
        slot = term * self.blocks + self.row // BLOCK
        self.ptr = np.searchsorted(slot, np.arange(len(vocabulary) * self.blocks + 1))
        self.most = np.zeros(len(vocabulary) * self.blocks)
        np.maximum.at(self.most, slot, self.weight)
        self.most = self.most.reshape(len(vocabulary), self.blocks)
        self.answers: dict[bytes, tuple] = {}
        self.curve = (0.0, 0.0)
        self.alone = 0.0

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Terms (numbers, ascending) and weights of length one."""
        if not text:
            return np.empty(0, int), np.empty(0)
        place, stems = self.place, self.stems
        words = _WORD.findall(text.lower())
        different = set(words)
        begun = [{w[:k] for w in different if len(w) > k} & stems.keys() for k in STEMS]
        hits = different & place.keys()
        if not hits and not any(begun):
            return np.empty(0, int), np.empty(0)
        counts = Counter(words)
        found = {place[word]: counts[word] for word in hits}
        for k, some in zip(STEMS, begun):
            for word, n in counts.items():
                if len(word) > k and word[:k] in some:
                    found[stems[word[:k]]] = found.get(stems[word[:k]], 0) + n
        return weigh(found, self.idf)

    def answer(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The nearest examples of a text and their cosines; equal vectors are answered once."""
        at, w = self.vector(text)
        name = xxhash.xxh3_128_digest(at.tobytes() + w.tobytes())
        found = self.answers.get(name)
        if found is None:
            if len(self.answers) >= ANSWERS_KEPT:
                self.answers.clear()
            found = self.answers[name] = self.nearest(at, w)
        return found

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k examples (numbers) with the largest cosine above 0, ties to the smaller key, and their cosines."""
        bounds = w @ self.most[at] if len(at) else np.zeros(self.blocks)
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        rows, cosines = np.empty(0, int), np.empty(0)
        while len(order):
            # first the few best blocks, then every block that can still reach the last neighbour
            least = cosines[k - 1] - 1e-9 if len(rows) >= k else -np.inf
            if not len(rows):
                opened, order = order[:FIRST_BLOCKS], order[FIRST_BLOCKS:]
            else:
                opened, order = order[bounds[order] >= least], order[:0]
            new, cos = self._open(at, w, opened)
            if without is not None:
                cos, new = cos[self.keys[new] != without], new[self.keys[new] != without]
            rows, cosines = np.concatenate((rows, new)), np.concatenate((cosines, cos))
            best = np.lexsort((self.keys[rows], -cosines))[:k]
            rows, cosines = rows[best], cosines[best]
        return rows, cosines

    def _open(self, at: np.ndarray, w: np.ndarray, opened: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The examples in the opened blocks that share a term, and their cosines."""
        slots = (at[:, None] * self.blocks + opened).ravel()
        lo = self.ptr[slots]
        n = self.ptr[slots + 1] - lo
        postings = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        sums = np.bincount(self.row[postings], np.repeat(np.repeat(w, len(opened)), n) * self.weight[postings], minlength=len(self.keys))
        rows = np.flatnonzero(sums)
        return rows, np.round(sums[rows], 12)

    def vote(self, rows: np.ndarray, cosines: np.ndarray) -> float:
        """The weighted share of toxic neighbours; a little weight goes to the share of all examples, so
        that far neighbours alone decide nothing."""
        weight = cosines ** 2 / (np.maximum(0.0, 1 - cosines) + 0.05)
        return float((weight @ self.labels[rows] + FAR_WEIGHT * self.labels.mean()) / (weight.sum() + FAR_WEIGHT))

    def score(self, rows: np.ndarray, cosines: np.ndarray) -> float:
        if not len(rows):
            return self.alone
        a, b = self.curve
        return float(1 / (1 + np.exp(-(a * self.vote(rows, cosines) + b))))

    def calibrate(self, vectors: list[tuple[np.ndarray, np.ndarray]], keys: list[int], labels: list[int]) -> None:
        """Fit the logistic curve to leave-one-out votes (Newton steps, slightly damped slope)."""
        votes, y, alone = [], [], [0, 0]
        for (at, w), key, label in zip(vectors, keys, labels):
            rows, cosines = self.nearest(at, w, without=key)
            if len(rows):
                votes.append(self.vote(rows, cosines))
                y.append(label)
            else:
                alone[label] += 1
        self.alone = (alone[1] + float(np.mean(labels))) / (sum(alone) + 1) if labels else 0.0
        x = np.stack((np.array(votes), np.ones(len(votes))), axis=1) if votes else np.empty((0, 2))
        y, beta, ridge = np.array(y, dtype=float), np.zeros(2), np.diag([0.5, 1e-3])
        for _ in range(50):
            p = 1 / (1 + np.exp(-x @ beta))
            step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ beta)
            beta += np.clip(step, -4, 4)
        self.curve = (float(max(0.0, beta[0])), float(beta[1]))


def weigh(counts: dict[int, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.array(sorted(counts), dtype=int)
    if not len(at):
        return at, np.empty(0)
    w = (1 + np.log([counts[i] for i in at])) * idf[at]
    return at, w / np.sqrt(w @ w)


def _vocabulary(examples: DataFrame, n: int, positive: int) -> list[str]:
    """The terms whose presence in an example depends most on its label."""
    out = pa.schema([("y", pa.int32()), ("term", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches, "t"):
            pairs = [(y, w) for y, t in zip(column(batch, "y").to_pylist(), column(batch, "t").to_pylist()) for w in terms(t)]
            yield batch_of(out, [[p[0] for p in pairs], [p[1] for p in pairs]])

    counted = examples.select("y", "t").mapInArrow(run, "y int, term string").groupBy("term").agg(
        F.count("*").cast("double").alias("d"), F.sum("y").cast("double").alias("p"))
    # 2 x 2 table of presence and label
    chi2 = (n * F.pow(F.col("p") * n - F.col("d") * positive, F.lit(2))
            / (F.col("d") * (n - F.col("d")) * positive * (n - positive)))
    rows = (counted.where((F.col("d") >= LEAST_EXAMPLES) & (F.col("d") < n)).select("term", chi2.alias("chi2"))
            .where(F.col("chi2") >= LEAST_CHI2).orderBy(F.desc("chi2"), "term").limit(VOCABULARY).collect())
    return sorted(r.term for r in rows)


def _frequencies(docs: DataFrame, vocabulary: list[str], text: str) -> tuple[np.ndarray, int]:
    """Documents that hold each term, and all documents.  A task sends at most one row a term."""
    out = pa.schema([("d", pa.int32()), ("n", pa.int64())])
    v = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        index = Index(vocabulary, np.ones(v), [], [], [])
        total = np.zeros(v + 1, dtype=np.int64)
        for batch in slices(batches, "t"):
            for t in column(batch, "t").to_pylist():
                total[index.vector(t)[0]] += 1
                total[v] += 1
        at = np.flatnonzero(total)
        yield batch_of(out, [at.astype(np.int32), total[at]])

    rows = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(run, "d int, n long").groupBy("d").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(v + 1, dtype=np.int64)
    for r in rows:
        total[r.d] = r.n
    return total[:v], int(total[v])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
          corpus: DataFrame | None = None) -> Index | None:
    """Build the index from the learning fold of ``labels``; document frequencies come from ``corpus`` (default: ``docs``)."""
    known = (labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key)))
             .groupBy(F.col(key).cast("long").alias("k")).agg(F.min(label).alias("y"), F.max(label).alias("z"))
             .where("y = z and y in (0, 1)"))
    known = known.select("k", F.col("y").cast("int").alias("y")).orderBy(F.xxhash64("k"), "k").limit(EXAMPLES)
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    examples = rows.join(F.broadcast(known), "k")  # at most EXAMPLES rows
    examples = examples.groupBy("t").agg(F.min(F.struct("k", "y")).alias("e")).select("e.k", "e.y", "t")  # copies would outvote others
    examples = examples.groupBy("k", "y").agg(F.min("t").alias("t"))  # repeated keys
    counts = {r.y: r.n for r in examples.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return None
    vocabulary = _vocabulary(examples, counts[0] + counts[1], counts[1])
    df, n = _frequencies(docs if corpus is None else corpus, vocabulary, text)
    idf = np.log((1 + n) / (1 + df)) + 1e-6
    plain = Index(vocabulary, idf, [], [], [])
    out = pa.schema([("k", pa.int64()), ("y", pa.int32()), ("at", pa.list_(pa.int32())), ("w", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            vectors = [plain.vector(t) for t in column(batch, "t").to_pylist()]
            yield batch_of(out, [column(batch, "k"), column(batch, "y"), [v[0].astype(np.int32) for v in vectors], [v[1] for v in vectors]])

    found = examples.select("k", "y", "t").mapInArrow(run, "k long, y int, at array<int>, w array<double>").collect()  # bounded
    found.sort(key=lambda r: r.k)
    keys, ys = [r.k for r in found], [r.y for r in found]
    vectors = [(np.array(r["at"], dtype=int), np.array(r.w)) for r in found]
    index = Index(vocabulary, idf, keys, ys, vectors)
    index.calibrate(vectors, keys, ys)
    return index


def score(docs: DataFrame, index: Index | None, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, score, predicted and evidence (the three nearest examples as ``key:label:cosine``) of
    every row, after the columns ``keep``."""
    from pyspark.sql import types as T
    names = [key, *(c for c in keep if c != key)]
    fields = [docs.schema[c] for c in names]
    extra = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()),
             T.StructField("evidence", T.ArrayType(T.StringType()))]
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by EXAMPLES and VOCABULARY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        m = shared.value
        for batch in slices(batches, read):
            scores, evidence = [], []
            for t in column(batch, read).to_pylist():
                rows, cosines = m.answer(t) if m is not None else ((), ())
                scores.append(m.score(rows, cosines) if m is not None else 0.0)
                evidence.append([f"{m.keys[r]}:{m.labels[r]}:{c:.4f}" for r, c in zip(rows[:3], cosines[:3])])
            yield pa.RecordBatch.from_arrays(
                [*(column(batch, c) for c in names), pa.array(scores, pa.float64()),
                 pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), pa.array(evidence, pa.list_(pa.string()))],
                names=[*names, "score", "predicted", "evidence"])

    # a text that is kept is sent once
    read = text if text in names and docs.schema[text].dataType == T.StringType() else "_text"
    rows = docs.select(*names, *([] if read == text else [F.col(text).cast("string").alias("_text")]))
    return rows.mapInArrow(run, T.StructType([*fields, *extra]))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Registered query: toxicity of every document."""
    docs = table(spark, sf_dir, "documents")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")


@guarded
def toxicity_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that are not predicted toxic."""
    names = docs.columns
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")), keep=tuple(names))
    return scored.where("predicted = 0").select(*names)
