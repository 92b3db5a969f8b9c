"""N-gram Jaccard self-join by universe partitioning.

A document's set holds the hashes (64 bits) of its different five-word
shingles; with fewer words, of the whole sequence.  Documents with equal sets
form a class, and classes are joined.

Index.  Sizes are cut into bands.  Within a band a hash deals the universe of
shingles into m segments, and every class is indexed by its subset in each
segment (a key for segment and subset).  A class is indexed in its own band,
and in the next one if it can be similar to a larger class there.  Two sets
with similarity 0.8 differ in at most H = 2 n / 9 shingles (n: size of the
larger), so of m segments m - H at least are equal.  Bands of small sets may be
partitioned more coarsely with one-deletion neighbourhoods: each subset is
indexed with all subsets that lack one shingle, and a segment counts for two
differences.  The cheaper kind is chosen for each band by the expected number
of rows and of chance candidates, from the number of classes in the band.

Allocation.  It is enough to look for partners of a class in H + 1 of its
segments.  Keys that no other class has cost nothing; of the others, the m -
(H + 1) most frequent ones are left out, so keys of empty segments and of
passages that many documents share are hardly ever looked up.  What is looked
up is looked up among all classes.  A pair whose larger set shares fewer than
m - H of its keys is left out before any set is touched (in bands with
deletions: fewer than one).

Verification compares whole sets.  First every class is compared with the one
that shares most keys among the best-connected classes of its keys; components
are formed; then all candidates that lie in different components.  No link
between components is lost: only comparisons inside one are saved.

Defined cases: words are cut at ASCII white space, A-Z lower-cased; a null
text, or one without words, has an empty set and its own id as component; a
null key stays null; rows that repeat a key each get their own set's component
(smallest key reachable); an empty table gives no rows.  Equal 64-bit hashes
of different shingles are taken for equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, exp

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, column, guarded, slices, table, written
from .components import components

WORDS = 5
#: Similarity as a fraction, and what follows for sets of sizes a <= b: they differ in (a + b) / 9 at most.
NUM, DEN = 80, 100
BAND_RATIO = 1.6
#: Segments beyond those needed, so that frequent keys can be left out.
SPARE = 0.12
#: What a candidate costs against an index row.
CANDIDATE_COST = 4.0
#: Keys (16 bytes) up to which a lookup is broadcast; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Bytes of a word from which it is hashed by itself.
LONG_WORD = 512

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_S29, _S32 = np.uint64(29), np.uint64(32)
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S32)) * _ODD[3]
    x = (x ^ (x >> _S29)) * _ODD[4]
    return x ^ (x >> _S32)


def _word_hashes(words: pa.Array) -> np.ndarray:
    """A hash of every word, eight bytes at a time, all words at once; very long words go alone."""
    wide = pa.types.is_large_string(words.type)
    bounds = np.frombuffer(words.buffers()[1], np.int64 if wide else np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    at, left = bounds[:-1], np.diff(bounds)
    data = np.concatenate((np.frombuffer(words.buffers()[2] or b"", np.uint8), np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))  # the eight bytes from every place on
    h = left.astype(np.uint64) * _ODD[2]
    long = np.flatnonzero(left > LONG_WORD)
    for n in long.tolist():
        h[n] = xxhash.xxh64_intdigest(data[at[n]:at[n] + left[n]])
    rest = np.flatnonzero((left > 0) & (left <= LONG_WORD))
    at, left = at[rest], left[rest]
    while len(rest):
        some = eight[at] & _FIRST_BYTES[np.minimum(left, 8)]
        h[rest] = _mix((h[rest] ^ some) + _ODD[0])
        more = left > 8
        rest, at, left = rest[more], at[more] + 8, left[more] - 8
    return h


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted different shingle hashes of each text.  Words are cut by Arrow and hashed all at once."""
    # A-Z and ASCII white space only; trimmed first: Arrow lowers slices of some string types wrongly
    texts = pc.ascii_lower(pc.ascii_trim_whitespace(pc.fill_null(texts, "")))
    split = pc.ascii_split_whitespace(texts)
    w = _word_hashes(split.values)
    bounds = split.offsets.to_numpy()
    full = len(w) - WORDS + 1
    every = _mix(sum(w[i:full + i] * _ODD[i] for i in range(WORDS))) if full > 0 else w[:0]
    out = []
    for lo, hi, filled in zip(bounds[:-1].tolist(), bounds[1:].tolist(), pc.not_equal(texts, "").to_pylist()):
        if not filled:
            out.append(np.empty(0, dtype=np.uint64))
        elif hi - lo < WORDS:
            h = np.array([hi - lo], dtype=np.uint64)
            for i in range(hi - lo):
                h = h + w[lo + i:lo + i + 1] * _ODD[i]
            out.append(_mix(h))
        else:
            found = np.sort(every[lo:hi - WORDS + 1])
            new = np.empty(len(found), dtype=bool)
            new[0] = True
            np.not_equal(found[1:], found[:-1], out=new[1:])
            out.append(found[new])
    return out


def class_of(found: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two signed numbers."""
    digest = xxhash.xxh3_128_intdigest(found.tobytes())
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    return sign(digest & (1 << 64) - 1), sign(digest >> 64)


def edges() -> list[int]:
    out = [1, 5]
    while out[-1] < 1 << 40:
        out.append(ceil(out[-1] * BAND_RATIO))
    return out


EDGES = np.array(edges())


def plan(band: int, classes: int) -> tuple[int, bool]:
    """(segments, with deletions) for a band, by expected index rows and chance candidates a class."""
    lo, hi = int(EDGES[band]), int(EDGES[band + 1]) - 1
    need = 2 * hi // 9 + 1
    size = (lo + hi) / 2
    single = need + ceil(SPARE * need) + 2
    empty = exp(-size / single)
    # a class has more empty segments than it can leave out: a Poisson tail
    mean, term, within = single * empty, exp(-single * empty), 0.0
    for i in range(single - need + 1):
        within += term
        term *= mean / (i + 1)
    single_cost = single + CANDIDATE_COST * classes * single * empty * empty * max(0.0, 1 - within)
    double = ceil(need / 2)
    c = size / double
    near_empty = exp(-c) * (1 + c)
    double_cost = double + size + CANDIDATE_COST * classes * double * near_empty * near_empty
    return (double, True) if double_cost < single_cost else (single, False)


def index_rows(found: np.ndarray, band: int, segments: int, deletions: bool) -> np.ndarray:
    """The keys of a set in a band."""
    salt = np.uint64((band + 1) * int(_ODD[2]) & (1 << 64) - 1)
    segment = ((_mix(found ^ salt) >> _S32) % np.uint64(segments)).astype(np.int64)
    element = _mix(found + _ODD[1])
    sums = np.zeros(segments, dtype=np.uint64)
    np.add.at(sums, segment, element)
    name = (np.uint64(band) << _S32) + np.arange(segments, dtype=np.uint64)
    keys = _mix(_mix(sums) + name * _ODD[0])
    if deletions:
        keys = np.concatenate((keys, _mix(_mix(sums[segment] - element) + name[segment] * _ODD[0])))
    return keys.view(np.int64)


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))


def sizes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """k, n, c1, c2 of every row: size and class of its set."""
    out = pa.schema([("k", pa.int64()), ("n", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            sets = shingle_sets(column(batch, "t"))
            names = [class_of(s) for s in sets]
            yield batch_of(out, [column(batch, "k"), [len(s) for s in sets], [a for a, _ in names], [b for _, b in names]])

    return _rows(docs, key, text).mapInArrow(run, "k long, n long, c1 long, c2 long")


def index(docs: DataFrame, plans: dict[int, tuple[int, bool]], key: str, text: str) -> DataFrame:
    """key, c1, spare: the index.  ``spare``: keys of the class that need not be looked up; -1 in the
    band of larger classes, where the class looks nothing up."""
    out = pa.schema([("key", pa.int64()), ("c1", pa.int64()), ("spare", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # the classes of this task: copies are indexed once
        for batch in slices(batches, "t"):
            keys, names, spares = [], [], []
            for found in shingle_sets(column(batch, "t")):
                n = len(found)
                if n < 4 or (name := class_of(found)) in seen:
                    continue
                seen.add(name)
                band = int(np.searchsorted(EDGES, n, side="right")) - 1
                wanted = []
                if (need := 2 * n // 9 + 1) > 1:  # else only equal sets are similar
                    wanted.append((band, need))
                if DEN * n >= NUM * int(EDGES[band + 1]):
                    wanted.append((band + 1, None))
                for b, need in wanted:
                    if b in plans:  # else there is no class of that size
                        segments, deletions = plans[b]
                        made = index_rows(found, b, segments, deletions)
                        keys.append(made)
                        names.append(np.full(len(made), name[0]))
                        spare = -1 if need is None else 0 if deletions else segments - need
                        spares.append(np.full(len(made), spare, dtype=np.int32))
            if keys:
                yield batch_of(out, [np.concatenate(keys), np.concatenate(names), np.concatenate(spares)])

    return _rows(docs, key, text).mapInArrow(run, "key long, c1 long, spare int")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets are similar."""
    needed = pairs.select(F.col("a").alias("c1")).union(pairs.select(F.col("b").alias("c1"))).distinct()
    needed = written(classes.join(needed, "c1", "left_semi").groupBy("c1").agg(F.min("rep").alias("k")), "op10-needed")
    wanted = needed.select("k").distinct()
    if needed.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    out = pa.schema([("c1", pa.int64()), ("set", pa.binary())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            found = shingle_sets(column(batch, "t"))
            yield batch_of(out, [[class_of(s)[0] for s in found], [s.tobytes() for s in found]])

    texts = _rows(docs, key, text).where("k is not null").join(wanted, "k", "left_semi").select("t")
    whole = texts.mapInArrow(sets, "c1 long, set binary").dropDuplicates(["c1"])
    whole = written(whole, "op10-sets")
    both = pairs.join(whole.select(F.col("c1").alias("a"), F.col("set").alias("sa")), "a").join(
        whole.select(F.col("c1").alias("b"), F.col("set").alias("sb")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "sa"):
            alike = []
            for x, y in zip(column(batch, "sa").to_pylist(), column(batch, "sb").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                every = np.concatenate((x, y))
                every.sort(kind="stable")
                shared = int((every[1:] == every[:-1]).sum())
                alike.append(DEN * shared >= NUM * (len(every) - shared))
            yield pa.RecordBatch.from_arrays([column(batch, "a"), column(batch, "b")], names=["a", "b"]).filter(pa.array(alike, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long")


def linked(docs: DataFrame, classes: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, root) of the classes that are linked to others; ``classes`` has c1, n, rep."""
    cut = F.lit(0)
    for i, e in enumerate(EDGES[:-1].tolist()):
        cut = F.when(F.col("n") >= e, F.lit(i)).otherwise(cut)
    counts = {r.band: r.n for r in classes.where("n > 0").groupBy(cut.alias("band")).agg(F.count("*").alias("n")).collect()}
    plans = {b: plan(b, n) for b, n in counts.items() if b < len(EDGES) - 1}

    by_key = Window.partitionBy("key")
    rows = index(docs, plans, key, text)
    rows = rows.withColumn("f", F.count("*").over(by_key)).withColumn("lo", F.min("c1").over(by_key)).withColumn("hi", F.max("c1").over(by_key))
    rows = written(rows.where("lo <> hi").select("key", "c1", "spare", "f").distinct(), "op10-shared")

    # allocation: a class leaves its most frequent keys out
    own = F.col("spare") >= 0
    rank = F.row_number().over(Window.partitionBy("c1", own).orderBy(F.desc("f"), "key"))
    hub = F.count("*").over(Window.partitionBy("c1"))
    rows = rows.withColumn("looks", own & (rank > F.col("spare"))).withColumn("hub", hub)
    rows = written(rows.select("key", "c1", "spare", "looks", "hub"), "op10-allocated")
    used = rows.groupBy("key").agg(F.max("looks").alias("used"), F.max(F.struct("hub", "c1", "looks")).alias("h"))
    used = used.where("used").select("key", F.col("h.c1").alias("c"), F.col("h.looks").alias("c_looks"))
    met = written(rows.select("key", "c1", "looks").join(used, "key"), "op10-met")
    short = F.shiftright("key", 32).cast("int")  # half a key; halves that are equal by chance only let a pair pass
    # the keys of one class; its own ones begin with those it looks up
    nodes = rows.groupBy("c1").agg(
        F.concat(F.collect_list(F.when(F.col("looks"), short)), F.collect_list(F.when(own & ~F.col("looks"), short))).alias("own"),
        F.count_if("looks").cast("int").alias("looks_up"), F.collect_list(short).alias("every"), F.max("spare").alias("spare"))
    nodes = written(nodes.join(classes.select("c1", "n"), "c1"), "op10-nodes")

    def enough(big: str, small: str) -> Column:
        """Sizes allow similarity, and the larger shares enough of its keys."""
        shared = F.size(F.array_intersect(F.col(f"{big}.own"), F.col(f"{small}.every")))
        return (DEN * F.col(f"{small}.n") >= NUM * F.col(f"{big}.n")) & (shared > F.greatest(F.col(f"{big}.spare"), F.lit(0)))

    # each class with the best-connected class of its keys that it shares most keys with
    stars = met.where("c1 <> c and (looks or c_looks)").groupBy("c1", "c").agg(F.count("*").alias("m"))
    stars = stars.groupBy("c1").agg(F.max_by("c", F.struct("m", "c")).alias("c"))
    stars = stars.join(nodes.alias("x"), "c1").join(nodes.withColumnRenamed("c1", "c").alias("y"), "c").where(F.when(F.col("x.n") >= F.col("y.n"), enough("x", "y")).otherwise(enough("y", "x")))
    stars = written(stars.select(F.col("c1").alias("a"), F.col("c").alias("b")), "op10-pairs")
    links = written(_verified(stars, classes, docs, key, text), "op10-links")
    found = written(components(links, "op10-stars"), "op10-components")

    # what lies in different components still
    labelled = met.select("key", "c1", "looks").join(found.withColumnRenamed("id", "c1"), "c1", "left").withColumn("root", F.coalesce("root", "c1"))
    several = labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    mixed = written(labelled.join(several, "key", "left_semi"), "op10-mixed")
    big = mixed.where("looks").select("key", "c1", "root").join(nodes.select("c1", "n", "spare", "own", "looks_up"), "c1")
    small = mixed.select("key", "c1", "root").join(nodes.select("c1", "n", "every"), "c1")
    rest = big.alias("x").join(small.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root"))
                               & (F.col("x.n") >= F.col("y.n"))
                               # a pair meets in the least of the keys it looks up
                               & (F.array_min(F.array_intersect(F.slice("x.own", 1, F.col("x.looks_up")), "y.every")) == F.shiftright("x.key", 32).cast("int"))
                               & enough("x", "y"))
    rest = rest.select(F.greatest("x.c1", "y.c1").alias("a"), F.least("x.c1", "y.c1").alias("b")).distinct()
    rest = rest.join(stars.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti")
    rest = written(rest, "op10-rest")
    more = written(links.union(_verified(rest, classes, docs, key, text)), "op10-links")
    return written(components(more, "op10-stars"), "op10-components")


def component_ids(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """k, n_shingles, component_id of every row."""
    rows = written(sizes(docs, key, text), "op10-sizes")
    classes = rows.where("n > 0 and k is not null").groupBy("c1", "c2", "n").agg(F.min("k").alias("rep"))
    classes = written(classes, "op10-classes")
    roots = linked(docs, classes, key, text)
    labelled = classes.join(roots.withColumnRenamed("id", "c1"), "c1", "left")
    least = labelled.where("root is not null").groupBy("root").agg(F.min("rep").alias("least"))
    labelled = labelled.join(least, "root", "left").select("c1", "c2", F.coalesce("least", "rep").alias("component"))
    out = rows.join(labelled, ["c1", "c2"], "left")
    component = F.when(F.col("k").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("k")).otherwise(F.col("component"))
    return out.select("k", F.col("n").alias("n_shingles"), component.cast("long").alias("component_id"))


def op10_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Registered query: doc_id, n_shingles, component_id of every document."""
    return component_ids(table(spark, sf_dir, "documents")).withColumnRenamed("k", "doc_id")


@guarded
def ngram_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the document with the smallest key.  Rows without a key
    stay; rows that repeat a key are one document and stay or go together."""
    names = docs.columns
    found = component_ids(docs).where("k is not null").groupBy("k").agg(F.min(F.col("k") != F.col("component_id")).alias("gone"))
    found = written(found.where("gone").select("k"), "op10-gone")
    found = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    return docs.join(found, F.col("doc_id").cast("long") == F.col("k"), "left_anti").select(*names)
