"""Token-id files: flat unsigned integers, 64-bit document offsets, memory-mapped.

A set of part files holds the token ids of all documents in ascending key
order.  Part ``p`` has ``<name>.bin`` (its ids back to back, little-endian
unsigned integers, two bytes while the vocabulary fits, else four),
``<name>.idx`` (unsigned 64-bit offsets, one more than documents) and
``<name>.key`` (signed 64-bit keys).  A manifest table names the file of every
part; the place of a part in the whole corpus is the prefix sum of the token
counts of the parts before it.

* Texts are encoded where they are read; only ids are shuffled.
* The parts are ranges of the key.  Their bounds are approximate quantiles of
  the key column, which is scanned alone, so nothing is encoded twice.
* A task writes its files under names of its own and reports them in the
  manifest, so a repeated or lost attempt leaves files nobody reads.

Defined cases: a null or empty text has only the end id; rows with equal keys
all stay, ordered by their ids; a null key comes first and is read back as
null; an empty table gives no files and no rows.  Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, column, partitions, scratch_path, slices, written
from .memory import Memory, kept_by_worker

#: Encoded units a worker remembers in each of two generations.
UNITS_KEPT = 400_000
#: Stands for a null key in a .key file.
NULL_KEY = np.iinfo(np.int64).min

_CUT = re.compile(r"(?<=[!-~])(?= [!-~])")
_FIRST, _STOP = "\x01", "\x02"  # mark the first word of a text, and a stop: no space precedes them


class UnitEncoder:
    """The ids of a text by the tokenizers library, unit by unit.

    A unit is a word with the space before it, a line break with the word after
    it, or the comma or full stop after a word.  Between two printable characters
    that are not spaces the byte-level pattern always breaks before a single space
    and on both sides of a single line break, and it parts letters and digits from
    a stop after them, so units are encoded independently and repeated units are
    looked up.  New words go to the library joined, and the ids are cut apart by
    the bytes they stand for.  Texts with other white space are cut only where
    both sides are plain; texts that may hold a special token's string go to the
    library whole.
    """

    def __init__(self, path: str, dtype: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker on each core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype(dtype)
        vocabulary = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)  # one character a byte
        for token, i in vocabulary.items():
            self.width[i] = len(token)
        self.units = Memory(self.joined, UNITS_KEPT)

    def alone(self, units: list[str]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast(units, add_special_tokens=False)
        return [np.asarray(c.ids, dtype=self.dtype).tobytes() for c in coded]

    def joined(self, units: list[str]) -> list[bytes]:
        """The ids of units."""
        size, out = self.dtype.itemsize, [b""] * len(units)
        marked = [n for n, u in enumerate(units) if u[:1] in (_FIRST, _STOP)]
        for n, ids in zip(marked, self.alone([units[n][1:] for n in marked])):
            out[n] = ids
        rest = [n for n, u in enumerate(units) if u[:1] not in (_FIRST, _STOP)]
        for i in range(0, len(rest), 2048):
            places = rest[i:i + 2048]
            some = [units[n] if units[n][:1] == "\n" else " " + units[n] for n in places]
            ids = np.asarray(self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, dtype=self.dtype)
            ends = np.cumsum(self.width[ids])
            cuts = np.cumsum([len(w.encode()) for w in some])
            at = np.searchsorted(ends, cuts) + 1
            if (ends[at - 1] != cuts).any():
                raise AssertionError("a token across two units")
            data, lo = ids.tobytes(), 0
            for n, hi in zip(places, at.tolist()):
                out[n] = data[lo * size:hi * size]
                lo = hi
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        plain, at, odd = [], [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            flat = text.replace("\n", " ")
            if "  " in flat or flat[0] == " " or flat[-1] == " " or "<|" in flat or not flat.isprintable():
                odd.append(i)
            else:
                at.append(i)
                plain.append(_FIRST + text.replace("\n", " \n"))
        cut = [t.replace(", ", f" {_STOP}, ").replace(". ", f" {_STOP}. ") for t in plain]
        uncut = self._looked_up(cut, at, out)
        self._looked_up([plain[n] for n in uncut], [at[n] for n in uncut], out)
        for i in odd:
            out[i] = b"".join(self.alone([texts[i]] if "<|" in texts[i] else _CUT.split(texts[i])))
        return out

    def _looked_up(self, plain: list[str], at: list[int], out: list[bytes]) -> list[int]:
        """Put the ids of texts (units parted by spaces) to their places in ``out``; the numbers of
        texts whose stops can't stand alone.  Arrow finds the different units; ids are put
        together by position."""
        if not plain:
            return []
        split = pc.split_pattern(pa.array(plain), " ")
        units = split.values.dictionary_encode()
        which, words = units.indices.to_numpy(), units.dictionary.to_numpy(zero_copy_only=False).tolist()
        offsets = split.offsets.to_numpy()
        found = self.units.all(words)
        stop = pc.starts_with(units.dictionary, _STOP).to_numpy(zero_copy_only=False)
        at_stop = np.flatnonzero(stop[which[1:]])
        before = which[at_stop]  # what stands before each stop
        word = np.zeros(len(words), dtype=bool)
        for n in np.unique(before).tolist():
            word[n] = words[n][-1:].isalnum()
        wrong = at_stop[~word[before]] + 1
        wrong = set((np.searchsorted(offsets, wrong, side="right") - 1).tolist())
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // self.dtype.itemsize
        ids = np.frombuffer(b"".join(found), dtype=self.dtype)
        starts = np.cumsum(lengths) - lengths
        each = lengths[which]
        ends = np.concatenate(([0], np.cumsum(each)))
        ids = ids[np.repeat(starts[which] - ends[:-1], each) + np.arange(ends[-1])]
        cuts = ends[offsets]
        for n, i in enumerate(at):
            if n not in wrong:
                out[i] = ids[cuts[n]:cuts[n + 1]].tobytes()
        return sorted(wrong)


@kept_by_worker
def unit_encoder(path: str, dtype: str) -> UnitEncoder:
    """One encoder for each worker process, so that later tasks find its memory filled."""
    return UnitEncoder(path, dtype)


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, dtype: str, bounds: list[int],
                     key: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, key, ids): the ids of every text with the end id, as little-endian bytes."""
    out = pa.schema([("part", pa.int32()), ("key", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = unit_encoder(tokenizer, dtype)
        end = np.asarray([end_id], dtype=dtype).tobytes()
        edges = np.asarray(bounds, dtype=np.int64)
        for batch in slices(batches, "text", rows=2048):
            keys = column(batch, "key")
            filled = keys.fill_null(int(NULL_KEY)).to_numpy(zero_copy_only=False)
            ids = encoder.encode(column(batch, "text").to_pylist())
            yield batch_of(out, [np.searchsorted(edges, filled, side="right").astype(np.int32), keys,
                                 [i + end for i in ids]])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "part int, key long, ids binary")


def write_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, vocabulary: int,
                key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Write the part files to ``folder`` and return the manifest
    (part, path, dtype, documents, tokens, base), one row per part."""
    spark = docs.sparkSession
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"
    parts = parts or partitions(spark)
    marks = [i / parts for i in range(1, parts)]
    bounds = docs.select(F.percentile_approx(F.col(key).cast("long"), marks, 20 * parts)).first()[0] if marks else []
    bounds = sorted(set(bounds or []))
    out = pa.schema([("part", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = handle = store = None
        done = []

        def close():
            handle.close()
            starts = np.concatenate(([0], np.cumsum(np.asarray(lengths, dtype=np.uint64)))).astype("<u8")
            for kind, data in ((".idx", starts), (".key", np.asarray(keys, dtype="<i8"))):
                with store.open_output_stream(path + kind) as f:
                    f.write(data.tobytes())
            done.append((part, f"{folder}/{name}", len(keys), int(starts[-1])))

        for batch in slices(batches):
            columns = (column(batch, "part").to_pylist(), column(batch, "key").to_pylist(), column(batch, "ids").to_pylist())
            for p, k, ids in zip(*columns):
                if p != part:
                    if handle is not None:
                        close()
                    part, lengths, keys = p, [], []
                    name = f"part-{p:06d}-{uuid.uuid4().hex[:12]}"
                    store, path = _open(f"{folder}/{name}")
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    handle = store.open_output_stream(path + ".bin")
                handle.write(ids)
                lengths.append(len(ids) // np.dtype(dtype).itemsize)
                keys.append(NULL_KEY if k is None else k)
        if handle is not None:
            close()
        if done:
            yield batch_of(out, [list(c) for c in zip(*done)])

    coded = encode_documents(docs, tokenizer, end_id, dtype, bounds, key, text)
    files = (coded.repartition(len(bounds) + 1, "part").sortWithinPartitions("part", "key", "ids")
             .mapInArrow(run, "part int, path string, documents long, tokens long"))
    files = written(files, "token-files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    return files.withColumns({"dtype": F.lit(dtype), "base": F.coalesce(F.sum("tokens").over(before), F.lit(0))})


class TokenFile:
    """One part, memory-mapped where the store is a local or mounted folder, else read by range."""

    def __init__(self, path: str, dtype: str):
        store, local = _open(path)
        self.dtype = np.dtype(dtype)
        with store.open_input_file(local + ".idx") as f:
            self.starts = np.frombuffer(f.read(), dtype="<u8")
        with store.open_input_file(local + ".key") as f:
            self.keys = np.frombuffer(f.read(), dtype="<i8")
        if isinstance(store, pafs.LocalFileSystem):
            self.map = np.memmap(local + ".bin", dtype=self.dtype, mode="r") if self.starts[-1] else None
            self.file = None
        else:
            self.file = store.open_input_file(local + ".bin")

    def __len__(self) -> int:
        return len(self.keys)

    def ids(self, i: int) -> np.ndarray:
        lo, hi = int(self.starts[i]), int(self.starts[i + 1])
        if self.file is not None:
            return np.frombuffer(self.file.read_at((hi - lo) * self.dtype.itemsize, lo * self.dtype.itemsize), self.dtype)
        return self.map[lo:hi] if hi > lo else np.empty(0, self.dtype)


def read_files(manifest: DataFrame) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, read from the files."""
    out = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def rows(path: str, dtype: str, base: int):
        part = TokenFile(path, dtype)
        for i in range(len(part)):
            ids = part.ids(i)
            key = int(part.keys[i])
            yield (None if key == NULL_KEY else key, base + int(part.starts[i]), len(ids),
                   zlib.crc32(ids.astype("<u4").tobytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, dtype, base in zip(*(column(batch, c).to_pylist() for c in ("path", "dtype", "base"))):
                found = rows(path, dtype, base)
                while some := list(islice(found, 4096)):
                    yield batch_of(out, [list(c) for c in zip(*some)])

    files = manifest.select("part", "path", "dtype", "base")
    return (files.repartition(partitions(files.sparkSession), "part")
            .mapInArrow(run, "key long, start long, n_tokens long, ids_crc32 long"))


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    """Registered query: doc_id, start, n_tokens, ids_crc32 of every document, from the written files."""
    import public_tokenizers

    from .common import table
    manifest = write_files(table(spark, sf_dir, "documents"), scratch_path(spark, "op8"),
                           public_tokenizers.path("byte_bpe_50k.json"), end_id=2, vocabulary=50_257)
    return read_files(manifest).withColumnRenamed("key", "doc_id")
