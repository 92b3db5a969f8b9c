"""Fuzzy line deduplication by MinHash.

The lines of all documents are sketched by the character shingles they hold:
40 signature values, each the least product of the lines' shingle hashes with a
number of its own, so two lines agree in a value with the probability of their
Jaccard similarity.  Four values in a row make one of ten bands; a pair of
similarity 0.8 agrees in some band with probability 0.995.  Lines that share
a band are candidates; the Jaccard similarity of their whole shingle sets
decides.  Verified links make components, and of each
component only the first line (smallest document key, then line number) stays.

Equal lines are one line from the first aggregation on (partial, so a line in a
third of all rows is one row for each task).  Every line is first compared with
the head of most of its bands, the line that occurs most there; verified links make components.
Lines whose bands have a head in common, and different components, are then compared pair by pair by their bitmaps, in which every
shingle of a set turns one bit: two lines of similarity 0.8 differ in a ninth of the sum of their
sizes at most, and their bitmaps in no more bits.  So of a group of lines that are alike, but not
enough, few pairs leave the join, and only their texts are compared.  Links and components stay distributed tables.

Sketches, shingle sets and similarities are computed by numpy over Arrow batches: with
DataFrame functions alone every shingle is a row, which is several times the budget of CPU
seconds and of disk (README).  All joins, groups and the union-find are DataFrame operations.

Defined cases: lines without a character besides white space are no lines and
always stay; a line shorter than a shingle is one shingle; a null text stays
null, an empty one empty; a very long line is sketched and compared whole; rows that repeat a key and a line at the same
place count once, so both keep it; rows that share a key (or have none) and differ
in text lose lines each by its own text; a null key comes after all others; a document
that loses all lines stays with an empty text; an empty table gives no rows;
other columns are kept by ``dedup`` as they are.  Equal 64-bit hashes of shingles are taken for equal
shingles (54 bits within a pair).
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, column, guarded, slices, table, written
from .components import components

SHINGLE = 8
SIMILARITY = 0.8
BANDS = 10
VALUES_PER_BAND = 4
#: Rows of a lookup (about 50 bytes each) up to which it is broadcast; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Counters of shingles by their hash, which order shingles by rarity (``prefixes``).
COUNTERS = 1 << 20
#: Two lines of the wanted similarity share 1 + n // SPARE of their prefixes, which are so much longer (n: the smaller set).
SPARE = 32
#: 64-bit words of the bitmap of a line's shingles.
WORDS = 32
#: Pairs, and characters of their lines, that a task compares at a time (one larger pair goes alone).
PAIRS_AT_A_TIME = 512
CHARACTERS_AT_A_TIME = 1 << 18
_random = random.Random(1)
FACTORS = [np.uint32(_random.getrandbits(32) | 1) for _ in range(BANDS * VALUES_PER_BAND)]
_MIX = np.uint64(_random.getrandbits(64) | 1)
_POWERS = [np.uint64(pow(int(_MIX), e, 1 << 64)) for e in (1, 2, 4)]
#: What follows every line in the array of code points; no character has this number.
_END = 0x110000


def shingle_hashes(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of the shingles of all lines, line after line, and the number of each line."""
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    end = "\0" * SHINGLE
    codes = np.frombuffer((end.join(found) + end).encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = lengths + SHINGLE
    at = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    codes[at >= np.repeat(lengths, sizes)] = _END
    n = np.maximum(lengths - SHINGLE, 0) + 1
    h = codes
    for power, step in zip(_POWERS, (1, 2, 4)):
        h = h[:-step] * power + h[step:]
    h = h[(at < np.repeat(n, sizes))[:len(h)]]
    h ^= h >> np.uint64(32)
    h *= _MIX
    return h ^ (h >> np.uint64(29)), n


def band_keys(found: list[str]) -> np.ndarray:
    """One row for each band, one column for each line."""
    h, n = shingle_hashes(found)
    x, starts = (h >> np.uint64(32)).astype(np.uint32), np.cumsum(n) - n
    product, keys = np.empty_like(x), np.empty((BANDS, len(n)), np.uint64)
    for band in range(BANDS):
        key = np.full(len(n), band + 1, np.uint64)
        for factor in FACTORS[band * VALUES_PER_BAND:(band + 1) * VALUES_PER_BAND]:
            np.multiply(x, factor, out=product)
            key = (key ^ np.minimum.reduceat(product, starts)) * _MIX
            key ^= key >> np.uint64(31)
        keys[band] = key
    return keys.view(np.int64)


def shared_shingles(xs: list[str], ys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of lines the sizes of both shingle sets and of what they share."""
    shift = np.uint64(54)
    sides = []
    for some in (xs, ys):
        h, n = shingle_hashes(some)
        pair = np.repeat(np.arange(len(some), dtype=np.uint64), n)
        key = np.sort((pair << shift) | (h >> np.uint64(10)))
        sides.append(key[np.concatenate(([True], key[1:] != key[:-1]))])
    both = np.sort(np.concatenate(sides))
    count = lambda key: np.bincount((key >> shift).astype(np.int64), minlength=len(xs))
    return count(sides[0]), count(sides[1]), count(both[1:][both[1:] == both[:-1]])


def bitmaps(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each line the size of its shingle set, and its bitmap (a row of words) in which every shingle of the set turns one bit."""
    h, n = shingle_hashes(found)
    line = np.repeat(np.arange(len(found)), n)
    order = np.lexsort((h, line))
    line, h = line[order], h[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (line[1:] != line[:-1])))
    line, h = line[new], h[new]
    bit = line * (64 * WORDS) + (h >> np.uint64(20)).astype(np.int64) % (64 * WORDS)
    turned = np.bincount(bit, minlength=len(found) * 64 * WORDS) & 1
    return np.bincount(line, minlength=len(found)), np.packbits(turned.astype(np.uint8)).view(np.int64).reshape(len(found), WORDS)


def prefixes(found: list[str], rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rarest shingles of each line, as many as needed to meet every line of the wanted similarity: the numbers
    of the lines, the hashes, and the size of each line's whole set."""
    h, n = shingle_hashes(found)
    line, count = np.repeat(np.arange(len(found)), n), rarity[(h % np.uint64(COUNTERS)).astype(np.int64)]
    order = np.lexsort((h, count, line))
    line, h = line[order], h[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (line[1:] != line[:-1])))
    line, h = line[new], h[new]
    size = np.bincount(line, minlength=len(found))
    rank = np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size)
    taken = rank < (size - np.ceil(SIMILARITY * size - 1e-9).astype(np.int64) + 1 + size // SPARE)[line]
    return line[taken], h[taken].view(np.int64), size


def lines(docs: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    """(doc, place, line), and the columns ``more``: the lines that count."""
    cut = docs.select(F.col(key).cast("long").alias("doc"), *more, F.posexplode(F.split(F.col(text).cast("string"), "\n")).alias("place", "line"))
    return cut.where(F.btrim("line", F.lit(" \t\r\f\u000b")) != "")


def _place() -> Column:
    """Document key and line number as one number in their order; a null key comes last."""
    key = F.coalesce(F.col("doc").cast("decimal(20,0)"), F.lit(str(1 << 63)).cast("decimal(20,0)"))
    return (key * F.lit(1 << 32).cast("decimal(11,0)") + F.col("place")).cast("decimal(38,0)")


def _hashes() -> tuple[Column, Column]:
    """128 bits that stand for a line."""
    return F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2")


def _text_hashes(text: str) -> tuple[Column, Column]:
    """128 bits that stand for a whole text; with the key they name a row."""
    whole = F.col(text).cast("string")
    return F.xxhash64(whole), F.xxhash64(F.lit("second"), whole)


def different_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each different line: id, h1, h2, first (place), n (occurrences), b0 .. b9 (bands)."""
    bands = [f"b{i}" for i in range(BANDS)]
    out = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("place", pa.int32()), *((b, pa.int64()) for b in bands)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "line"):
            keys = band_keys(column(batch, "line").to_pylist())
            yield batch_of(out, [*(column(batch, c) for c in ("h1", "h2", "doc", "place")), *keys])

    rows = lines(docs, key, text).select(*_hashes(), "doc", "place", "line")
    rows = rows.mapInArrow(run, "h1 long, h2 long, doc long, place int, " + ", ".join(f"{b} long" for b in bands))
    found = rows.withColumn("p", _place()).groupBy("h1", "h2").agg(F.min("p").alias("first"), F.count("*").alias("n"), *[F.first(b).alias(b) for b in bands])
    return written(found.withColumn("id", F.monotonically_increasing_id()), "op4-lines")


def _texts(wanted: DataFrame, known: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, line) of the lines ``wanted`` (id)."""
    needed = written(known.join(wanted, "id", "left_semi").select("id", "h1", "h2", "first"), "op4-needed")
    needed = F.broadcast(needed) if needed.count() <= BROADCAST_ROWS else needed
    texts = lines(docs, key, text).select(*_hashes(), _place().alias("p"), "line").join(needed, ["h1", "h2"]).where("p = first")
    return written(texts.select("id", "line").dropDuplicates(["id"]), "op4-texts")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of lines whose whole shingle sets have the wanted similarity."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "x", PAIRS_AT_A_TIME):
            xs, ys = column(batch, "x").to_pylist(), column(batch, "y").to_pylist()
            at = np.cumsum([len(x) + len(y) for x, y in zip(xs, ys)]) // CHARACTERS_AT_A_TIME
            cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(xs)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo < hi:
                    n, m, shared = shared_shingles(xs[lo:hi], ys[lo:hi])
                    linked = np.flatnonzero(shared >= SIMILARITY * (n + m - shared))
                    kept = batch.slice(lo, hi - lo).take(pa.array(linked))
                    yield batch_of(out, [column(kept, "a"), column(kept, "b")])

    met = pairs.select("a", "b").join(texts.select(F.col("id").alias("b"), F.col("line").alias("y")), "b").join(
        texts.select(F.col("id").alias("a"), F.col("line").alias("x")), "a")
    return met.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _marked(texts: DataFrame) -> DataFrame:
    """(id, n, w0, w1 ..): the sizes of the shingle sets and the words of the bitmaps of the lines."""
    words = [f"w{i}" for i in range(WORDS)]
    out = pa.schema([("id", pa.int64()), ("n", pa.int64()), *((w, pa.int64()) for w in words)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "line"):
            n, bits = bitmaps(column(batch, "line").to_pylist())
            yield batch_of(out, [column(batch, "id"), n, *np.ascontiguousarray(bits.T)])

    return texts.select("id", "line").mapInArrow(run, "id long, n long, " + ", ".join(f"{w} long" for w in words))


def _near_pairs(mixed: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b), a > b: the pairs of lines with different roots that share one of the heads c of
    ``mixed`` (c, id, root) and may have the wanted similarity.

    Bitmaps differ in as many bits as the sets in shingles at most, and sets of similarity s in (1 - s) / (1 + s) of the
    sum of their sizes at most, so no link is lost."""
    marked = written(_marked(texts.join(mixed.select("id").distinct(), "id", "left_semi")), "op4-marked")
    rows = mixed.join(marked, "id")
    u, v = rows.alias("u"), rows.alias("v")
    sizes = (F.col("u.n") >= SIMILARITY * F.col("v.n") - 1e-6) & (F.col("v.n") >= SIMILARITY * F.col("u.n") - 1e-6)
    differ = sum((F.bit_count(F.col(f"u.w{i}").bitwiseXOR(F.col(f"v.w{i}"))) for i in range(1, WORDS)), F.bit_count(F.col("u.w0").bitwiseXOR(F.col("v.w0"))))
    near = differ <= (F.col("u.n") + F.col("v.n")) * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 1e-6
    met = u.join(v, (F.col("u.c") == F.col("v.c")) & (F.col("u.id") > F.col("v.id")) & (F.col("u.root") != F.col("v.root")) & sizes & near)
    return met.select(F.col("u.id").alias("a"), F.col("v.id").alias("b")).distinct()


def line_components(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, root) of the lines that are linked to another line."""
    modulus = F.lit(str(1 << 64)).cast("decimal(20,0)")  # occurrences, then the smaller id, as one number that hash aggregation can keep
    rank = (F.col("n").cast("decimal(17,0)") * modulus - F.col("id").cast("decimal(20,0)")).cast("decimal(38,0)")
    banded = known.select("id", "n", F.explode(F.array(*[f"b{i}" for i in range(BANDS)])).alias("band"))
    # nearly all bands are met once, so only their numbers are counted; no band is gathered: its head, the line
    # that occurs most (near copies are mostly nearer to it than to each other), is aggregated first, then joined to its rows
    repeated = written(banded.groupBy("band").agg(F.count("*").alias("m")).where("m > 1").select("band"), "op4-bands")
    met = written(banded.join(repeated, "band"), "op4-met")
    heads = met.groupBy("band").agg(F.max(rank).alias("c")).select("band", F.pmod(-F.col("c"), modulus).cast("long").alias("c"))
    shared = written(met.drop("n").join(heads, "band"), "op4-shared")

    # every line with the one that is the head of most of its bands
    tested = shared.where("id <> c").groupBy(F.col("id").alias("a")).agg(F.mode("c", True).alias("b"))  # of at most BANDS values
    tested = written(tested, "op4-pairs")
    texts = _texts(shared.select("id").distinct(), known, docs, key, text)
    links = written(_verified(tested, texts), "op4-links")
    found = written(components(links, "op4-stars"), "op4-components")

    # then all pairs of lines whose bands have a head in common (so all that share a band), by bitmaps
    # (heads of one component are one, as near copies of near copies may be alike too)
    heads = found.select(F.col("id").alias("c"), F.col("root").alias("top"))
    named = shared.join(heads, "c", "left").select(F.coalesce("top", "c").alias("c"), "id").distinct()
    labelled = named.join(found, "id", "left").select("c", "id", F.coalesce("root", "id").alias("root"))
    several = labelled.groupBy("c").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("c")
    mixed = written(labelled.join(several, "c", "left_semi"), "op4-mixed")
    more = written(links.union(_verified(written(_near_pairs(mixed, texts), "op4-rest"), texts)), "op4-links")
    return written(components(more, "op4-stars"), "op4-components")


def dropped(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, t1, t2, places): for each key and text that loses lines, their numbers."""
    known = different_lines(docs, key, text)
    roots = line_components(docs, known, key, text)
    joined = known.join(roots, "id", "left")
    keeps = joined.where("root is not null").groupBy("root").agg(F.min("first").alias("keep"))
    doubled = joined.where("root is not null or n > 1").join(keeps, "root", "left")
    doubled = written(doubled.select("h1", "h2", F.coalesce("keep", "first").alias("keep")), "op4-doubled")
    lookup = F.broadcast(doubled) if doubled.count() <= BROADCAST_ROWS else doubled
    t1, t2 = _text_hashes(text)
    named = docs.select(key, text, t1.alias("t1"), t2.alias("t2"))  # once a row, not once a line
    rows = lines(named, key, text, "t1", "t2").select(*_hashes(), "doc", "t1", "t2", "place", _place().alias("p"))
    rows = rows.join(lookup, ["h1", "h2"]).where("p <> keep")
    return written(rows.groupBy("doc", "t1", "t2").agg(F.collect_set("place").alias("places")), "op4-dropped")  # lines of one document


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the remaining lines as its text, and ``_lines`` and ``_kept`` (counts)."""
    gone = dropped(docs, key, text).select(F.col("doc").alias("_doc"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), F.col("places").alias("_places"))
    t1, t2 = _text_hashes(text)
    rows = docs.join(gone, F.col(key).cast("long").eqNullSafe(F.col("_doc")) & (t1 == F.col("_t1")) & (t2 == F.col("_t2")), "left")
    cut = F.split(F.col(text).cast("string"), "\n")
    kept = F.filter(cut, lambda x, i: ~F.array_contains("_places", i))
    new = F.when(F.col("_places").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    whole = F.col(text).isNull() | F.col("_places").isNull()
    return (rows.withColumn("_lines", F.when(F.col(text).isNull(), 0).otherwise(F.size(cut)).cast("long"))
            .withColumn("_kept", F.when(whole, F.col("_lines")).otherwise(F.size(kept)).cast("long"))
            .withColumn(text, new).drop("_doc", "_t1", "_t2", "_places"))


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Registered query: doc_id, n_lines (cut at line breaks), n_kept and md5 of the remaining text of every document."""
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_kept").alias("n_kept"),
                      F.md5(F.col("text").cast("binary")).alias("text_md5"))


@guarded
def line_dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents without the lines that repeat an earlier one.  A document goes
    if that takes all its lines; one that had none stays."""
    names = docs.columns
    had = F.coalesce(F.btrim(F.col("text").cast("string"), F.lit(" \n\t\r\f\u000b")) != "", F.lit(False))
    out = dedup(docs.withColumn("_had", had))
    left = F.btrim(F.col("text").cast("string"), F.lit(" \n\t\r\f\u000b")) != ""
    out = out.where(~F.col("_had") | left)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*names)
