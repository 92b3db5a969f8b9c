"""Quality rules: gradient-boosted trees over document statistics.

Statistics of a text are counted in one pass.  Trees are fitted on the driver
from a bounded sample of labelled rows (``MAX_TRAIN`` rows, chosen by hash of
the key) and flattened into numpy node arrays, which score whole batches at
once.  Chosen features have a monotonic constraint: more symbols, repeated
lines or repeated words never raise a score.

Words are ``[^\\x20\\x09-\\x0D]+``.  Base rules: a document fails with fewer than
50 words, or if more than half of its words lie in three-word windows that
occur twice or more.

Defined cases: a null text has no words and fails the base rules; an empty
table gives no rows; without labels of both kinds the trees are left out and
the base rules decide; labels that contradict each other for a key are not
learnt from.  Repeated rows give repeated results.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, column, held_out, slices

#: Labelled rows that the trees are fitted on, at most.
MAX_TRAIN = 20_000
TREES, DEPTH, BINS, RATE, LEAST_WEIGHT, L2 = 60, 3, 32, 0.2, 5.0, 1.0
#: Feature names and the direction in which they may move the score (0: either).
FEATURES = {"log_words": 0, "word_length": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1,
            "upper_share": 0, "digit_share": 0, "punct_share": 0, "distinct_share": 0, "words_per_line": 0}
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """By code point of the basic plane: 1 upper case, 2 digit, 3 punctuation or symbol, 4 a
    white-space byte, 0 others."""
    kinds = np.zeros(1 << 16, dtype=np.uint8)
    for c in range(1 << 16):
        kind = unicodedata.category(chr(c))
        kinds[c] = 1 if kind == "Lu" else 2 if kind == "Nd" else 3 if kind[0] in "PS" else 0
    kinds[[32, *range(9, 14)]] = 4
    return kinds


def repeated_words(numbers: np.ndarray, n: int) -> int:
    """Words (as numbers below ``n``) that lie in a three-word window found twice or more."""
    if len(numbers) < 4:
        return 0
    pair = numbers[:-1] * n + numbers[1:]
    if n >= 1 << 20:  # keep the next product below 2^63
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    triple = pair[:-1] * n + numbers[2:]
    order = np.argsort(triple, kind="stable")
    same = triple[order[1:]] == triple[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(triple), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(numbers), dtype=bool)
    for k in range(3):
        covered[k:len(numbers) - 2 + k] |= twice
    return int(covered.sum())


def statistics(text: str | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """(base counts in the order of ``BASE``, features in the order of ``FEATURES``)."""
    text = text or ""
    raw = text.encode("utf-8")
    words = raw.split()  # ASCII white space
    number: dict[bytes, int] = {}
    numbers = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    lines = raw.split(b"\n")
    seen, dup, filled = set(), 0, 0
    for line in lines:
        if line.split(None, 1):
            filled += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    kinds = np.bincount(_classes()[np.minimum(codes, 0xFFFF)], minlength=5)
    n, chars = len(words), len(codes) - int(kinds[4])
    symbols = sum(raw.count(s.encode()) for s in SYMBOLS)
    repeat = repeated_words(numbers, max(1, len(number)))
    share = lambda a, b: a / b if b else 0.0
    features = (float(np.log1p(n)), share(chars, n), share(symbols, n), share(dup, filled), share(repeat, n),
                share(int(kinds[1]), chars), share(int(kinds[2]), chars), share(int(kinds[3]), chars),
                share(len(number), n), share(n, filled))
    return (n, chars, symbols, dup, repeat), features


@dataclass
class Trees:
    """All trees in flat node arrays; a leaf is its own child on both sides."""
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of good quality for the rows of ``x``."""
        if not len(self.roots):
            return np.full(len(x), self.start)
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.start + self.value[at].sum(axis=1)


def fit_trees(x: np.ndarray, y: np.ndarray, directions: list[int]) -> Trees:
    """Boosted logistic trees on histogram bins.  A split on a constrained feature must order its
    sides, and the middle of the two values bounds everything below them."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
    bins = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(m)], axis=1)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(p / (1 - p)))
    margin = np.full(n, start)
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots = []

    def best_split(rows, grad, hess, lo, hi):
        g, h = grad[rows].sum(), hess[rows].sum()
        found = None
        for j in range(m):
            gs = np.bincount(bins[rows, j], weights=grad[rows], minlength=BINS + 1).cumsum()[:-1]
            hs = np.bincount(bins[rows, j], weights=hess[rows], minlength=BINS + 1).cumsum()[:-1]
            k = len(edges[j])
            gl, hl = gs[:k], hs[:k]
            wl = np.clip(-gl / (hl + L2), lo, hi)
            wr = np.clip(-(g - gl) / (h - hl + L2), lo, hi)
            gain = -(gl * wl + (hl + L2) * wl ** 2 / 2) - ((g - gl) * wr + (h - hl + L2) * wr ** 2 / 2)
            ok = (hl >= LEAST_WEIGHT / 4) & (h - hl >= LEAST_WEIGHT / 4)
            if directions[j]:
                ok &= directions[j] * (wr - wl) >= 0
            gain = np.where(ok, gain, -np.inf)
            if k and (best := int(np.argmax(gain))) is not None and (found is None or gain[best] > found[0]):
                found = (gain[best], j, best, wl[best], wr[best])
        w = np.clip(-g / (h + L2), lo, hi)
        here = -(g * w + (h + L2) * w ** 2 / 2)
        return (found if found and found[0] > here + 1e-6 else None), w

    def grow(rows, grad, hess, depth, lo, hi):
        split, w = best_split(rows, grad, hess, lo, hi) if depth else (None, np.clip(-grad[rows].sum() / (hess[rows].sum() + L2), lo, hi))
        node = len(nodes)
        nodes.append([0, np.inf, node, node, RATE * float(w)])
        if split is None:
            margin[rows] += RATE * float(w)
            return node
        _, j, b, wl, wr = split
        goes = bins[rows, j] <= b
        mid, (llo, lhi), (rlo, rhi) = (wl + wr) / 2, (lo, hi), (lo, hi)
        if directions[j] > 0:
            lhi, rlo = mid, mid
        elif directions[j] < 0:
            llo, rhi = mid, mid
        left = grow(rows[goes], grad, hess, depth - 1, llo, lhi)
        right = grow(rows[~goes], grad, hess, depth - 1, rlo, rhi)
        nodes[node] = [j, float(edges[j][b]), left, right, 0.0]
        return node

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(n), p - y, p * (1 - p), DEPTH, -np.inf, np.inf))
    cols = list(zip(*nodes))
    return Trees(np.array(roots), np.array(cols[0]), np.array(cols[1], dtype=float), np.array(cols[2]),
                 np.array(cols[3]), np.array(cols[4], dtype=float), DEPTH, start)


NO_TREES = Trees(*[np.empty(0, dtype=int)] * 6, depth=0, start=np.inf)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
          limit: int = MAX_TRAIN) -> Trees:
    """Fit the trees on at most ``limit`` labelled rows of the learning fold."""
    known = (labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key)))
             .groupBy(F.col(key).alias("k")).agg(F.min(label).alias("y"), F.max(label).alias("z")).where("y = z and y in (0, 1)")
             .select("k", "y").orderBy(F.xxhash64("k"), "k").limit(limit))
    out = pa.schema([("k", pa.int64()), ("y", pa.int32()), ("f", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            f = [list(statistics(t)[1]) for t in column(batch, "t").to_pylist()]
            yield batch_of(out, [column(batch, "k"), column(batch, "y"), f])

    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    rows = rows.join(F.broadcast(known.select(F.col("k").cast("long"), F.col("y").cast("int"))), "k")  # at most `limit` rows
    rows = rows.mapInArrow(run, "k long, y int, f array<double>").orderBy("k", "f").limit(2 * limit).collect()
    y = np.array([r.y for r in rows], dtype=float)
    if not len(y) or y.min() == y.max():
        return NO_TREES
    return fit_trees(np.array([r.f for r in rows]), y, list(FEATURES.values()))


def judge(docs: DataFrame, trees: Trees, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """key, the base counts, base_failed, quality (probability) and kept of every row."""
    cut = float(np.log(threshold / (1 - threshold)))
    out = pa.schema([(key, pa.int64()), *((c, pa.int64()) for c in BASE), ("base_failed", pa.bool_()),
                     ("kept", pa.bool_()), ("quality", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            found = [statistics(t) for t in column(batch, "_text").to_pylist()]
            base = np.array([b for b, _ in found], dtype=np.int64).reshape(-1, len(BASE))
            margin = trees.score(np.array([f for _, f in found]).reshape(-1, len(FEATURES)))
            failed = (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > MAX_REPEAT_PERCENT * base[:, 0])
            yield batch_of(out, [column(batch, key), *base.T, failed, ~failed & (margin >= cut), 1 / (1 + np.exp(-margin))])

    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"`{key}` long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean, quality double")


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Registered query: statistics and verdict of every document."""
    from .common import table
    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))
