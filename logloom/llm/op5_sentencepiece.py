"""SentencePiece BPE encoding and decoding by a prefix table.

Every prefix of a text has one last token in its BPE encoding.  The table of
these last tokens is filled from left to right: the pieces that end at a
position come from an Aho-Corasick automaton over the vocabulary, and the one
piece that is compatible with the last token of the prefix before it is the
entry.  The ids are then recovered backwards from the end of the text.

Two adjacent tokens are compatible when merging their characters never merges
across their border.  The merges inside a token take the same course alone as
beside a neighbour until the border is crossed, so the test replays both
courses, remembered per token, and asks at each step whether the symbols at
the border would merge first.

Characters outside the vocabulary become their UTF-8 byte pieces.  Where no
piece holds the space mark after another character (checked when the model is
loaded), a text is cut before each run of space marks; no piece holds a line
break, and none a letter beside another character, so it is cut there too (each
checked in the same way).  Short units that repeat are looked up.

Defined cases: a null text counts as empty; an empty text has the end id only.
Repeated rows give repeated results, an empty table none.  Other columns are
ignored (and kept where ``keep`` names them).
"""

from __future__ import annotations

import codecs
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, column, slices
from .memory import Memory, forget, kept_by_worker

SPACE = "▁"
codecs.register_error("each_byte", lambda e: ("\ufffd", e.start + 1))  # one replacement for each byte that fits nowhere
#: Units (in each of two generations) and compatibility answers a worker remembers.
UNITS_KEPT = 400_000
#: The same in the pipeline, whose executors also hold what the stages before have left.
PIPELINE_UNITS_KEPT = 200_000
PAIRS_KEPT = 200_000
#: Longer units are encoded anew each time (the memories stay bounded in bytes).
UNIT_CHARS = 24

#: Letters, roughly: ASCII letters and what lies beyond Latin-1's signs, without the blocks of symbols.
_L = "A-Za-zÀ-ÖØ-öø-\u1fff\u2c00-\u2fff\u3040-\U0010ffff"
_LETTERS = re.compile(rf"{SPACE}*[{_L}]+|{SPACE}*[^{_L}{SPACE}]+|{SPACE}+")
_MIXED = re.compile(rf"[{_L}][^{_L}{SPACE}]|[^{_L}{SPACE}][{_L}]")
_RUNS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class PieceTable:
    """Encoder and decoder for one BPE model file with byte fallback."""

    def __init__(self, path: str, kept: int = UNITS_KEPT):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models without text normalisation are supported")
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback are supported")
        self.dummy = spec.add_dummy_prefix
        self.bytes, self.pieces, unknown = {}, [], {}
        self.unknown: set[int] = set()
        self.score, self.id_of = {}, {}
        for i, piece in enumerate(model.pieces):
            self.pieces.append(piece.piece)
            if piece.type == 1:
                self.score[piece.piece] = piece.score
                self.id_of[piece.piece] = i
            elif piece.type == 6:
                self.bytes[i] = int(piece.piece[3:5], 16)
            elif piece.type == 2:
                unknown[i] = model.trainer_spec.unk_surface
                self.unknown.add(i)
            elif piece.type == 3:
                unknown[i] = ""
            else:
                raise ValueError(f"piece type {piece.type} is not supported")
        self.byte_id = {b: i for i, b in self.bytes.items()}
        self.automaton = ahocorasick.Automaton()
        for piece in self.score:
            if len(piece) > 1:
                self.automaton.add_word(piece, (len(piece), piece))
        self.automaton.make_automaton()
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in self.score)
        self.breaks = not any("\n" in p for p in self.score)
        self.words = self.cuts and not any(_MIXED.search(p) for p in self.score)
        self.runs: dict[str, bytes] = {}
        self.courses: dict[str, tuple] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.number = np.array([str(i) for i in range(len(self.pieces))], dtype=object)
        self.kept = kept
        self.units = Memory(self._entries, kept, UNIT_CHARS)
        # what an id adds to a text; a byte below 128 is a character of its own
        surface = [p.replace(SPACE, " ") for p in self.pieces]
        self.high = np.zeros(len(surface), dtype=bool)
        for i, b in self.bytes.items():
            surface[i], self.high[i] = chr(b), b > 127
        for i, mark in unknown.items():
            surface[i] = mark
        self.surface = np.array(surface, dtype=object)

    def course(self, token: str) -> tuple:
        """How the characters of ``token`` merge alone: per step the score, the
        first and the last symbol after it; whether one symbol is left."""
        found = self.courses.get(token)
        if found is None:
            symbols, steps, score = list(token), [], self.score
            first_last = (symbols[0], symbols[-1])
            while len(symbols) > 1:
                best = None
                for i in range(len(symbols) - 1):
                    s = score.get(symbols[i] + symbols[i + 1])
                    if s is not None and (best is None or s > best[0]):
                        best = (s, i)
                if best is None:
                    break
                s, i = best
                symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]
                steps.append((s, symbols[0], symbols[-1]))
            found = self.courses[token] = (first_last, steps, len(symbols) == 1)
        return found

    def compatible(self, left: str, right: str) -> bool:
        """True if the characters of ``left + right`` merge to exactly these two tokens."""
        (_, end), lsteps, _ = self.course(left)
        (start, _), rsteps, whole = self.course(right)
        if not whole:
            return False
        score = self.score
        i = j = 0
        while True:
            cross = score.get(end + start)
            ls = lsteps[i][0] if i < len(lsteps) else None
            rs = rsteps[j][0] if j < len(rsteps) else None
            if cross is not None and (ls is None or cross > ls) and (rs is None or cross >= rs):
                return False
            if ls is not None and (rs is None or ls >= rs):
                end = lsteps[i][2]
                i += 1
            elif rs is not None:
                start = rsteps[j][1]
                j += 1
            else:
                return True

    def tokens(self, unit: str) -> list[str]:
        """The tokens of a unit: fill the last-token table, then go backwards.

        Exactly one piece that ends at a position is compatible, so a position
        where no longer piece is has its single character."""
        n = len(unit)
        last: list[str] = [""] * (n + 1)
        pairs = self.pairs
        if len(pairs) > PAIRS_KEPT:
            pairs.clear()
        done = 0  # prefixes up to this length have their last token
        for at, (size, piece) in self.automaton.iter(unit):  # by their end, the longest of an end first
            end = at + 1
            if end <= done:
                continue  # a longer piece was compatible
            for i in range(done + 1, end):  # only the single character was left there
                last[i] = unit[i - 1]
            done = end - 1
            if size == end:
                fits = self.course(piece)[2]
            else:
                key = (last[end - size], piece)
                fits = pairs.get(key)
                if fits is None:
                    fits = pairs[key] = self.compatible(*key)
            if fits:
                last[end] = piece
                done = end
        for i in range(done + 1, n + 1):
            last[i] = unit[i - 1]
        out = []
        while n:
            out.append(last[n])
            n -= len(last[n])
        return out[::-1]

    def ids_of(self, unit: str) -> list[int]:
        """The ids of a unit (spaces already marked)."""
        ids = list(map(self.id_of.get, tokens := self.tokens(unit)))
        if None in ids:
            parts = [[i] if i is not None else [self.byte_id[b] for b in t.encode()] for i, t in zip(ids, tokens)]
            ids = [i for part in parts for i in part]
        return ids

    def _run(self, run: str) -> bytes:
        """The ids of a run that is not remembered."""
        found = array("i", self.ids_of(run)).tobytes()
        if len(run) <= UNIT_CHARS:
            if len(self.runs) > self.kept:
                self.runs = {}
            self.runs[run] = found
        return found

    def _entry(self, unit: str) -> bytes:
        if not self.words:
            return array("i", self.ids_of(unit)).tobytes()
        found = [self.runs.get(run) or self._run(run) for run in _LETTERS.findall(unit)]
        return found[0] if len(found) == 1 else b"".join(found)

    def _entries(self, units: list[str]) -> list[bytes]:
        """The ids (as bytes) of units: words that a space precedes, or line breaks with what follows them."""
        return [self._entry(unit if unit[:1] == "\n" else SPACE + unit) for unit in units]

    def entries(self, text: str) -> list[bytes]:
        """The ids (as bytes) of the units of ``text``, in order."""
        if not text:
            return []
        if self.cuts and self.breaks and self.dummy and text[0] != " " and "  " not in text and SPACE not in text:
            # a unit is a word with its space mark, or a line break with what follows it
            return self.units.all(text.replace("\n", " \n").split(" "))
        marked = text.replace(" ", SPACE)
        if self.dummy:
            marked = SPACE + marked
        if not self.cuts:
            return [self._entry(marked)]
        return [self._entry(unit) for unit in _RUNS.findall(marked)]

    def encode(self, text: str) -> np.ndarray:
        """The ids of ``text`` (no begin or end id)."""
        return np.frombuffer(b"".join(self.entries(text)), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``: pieces joined, byte runs read as UTF-8, the
        dummy space taken off, control ids left out."""
        ids = np.asarray(ids, dtype=np.int64)
        if not self.high[ids].any():
            text = "".join(self.surface[ids].tolist())
        else:
            parts, run = [], bytearray()
            for i in ids.tolist():
                if i in self.bytes:
                    run.append(self.bytes[i])
                    continue
                if run:
                    parts.append(run.decode("utf-8", "each_byte"))
                    run = bytearray()
                parts.append(self.surface[i])
            parts.append(run.decode("utf-8", "each_byte"))
            text = "".join(parts)
        if self.dummy and text.startswith(" "):
            first = next(i for i in ids.tolist() if self.surface[i])
            return text if first in self.unknown else text[1:]  # the mark for unknown ids keeps its space
        return text


@kept_by_worker
def piece_table(path: str, kept: int = UNITS_KEPT) -> PieceTable:
    """One table for each worker process, so that later tasks find its memories filled; what other operators
    left in the process goes first."""
    forget()
    return PieceTable(path, kept)


def encode_documents(docs: DataFrame, model: str, end_id: int | None = 2, text: str = "text",
                     keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with ``ids`` (array of int) and ``decoded`` (their text)."""
    fields = [f for f in docs.schema.fields if f.name in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(model)
        tail = np.array([] if end_id is None else [end_id], dtype=np.int32)
        for batch in slices(batches, "_text"):
            ids, decoded = [], []
            for t in column(batch, "_text").to_pylist():
                ids.append(np.concatenate((table.encode(t or ""), tail)))
                decoded.append(table.decode(ids[-1]))
            columns = [column(batch, f.name) for f in fields]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())],
                names=[*(f.name for f in fields), "ids", "decoded"])

    from pyspark.sql import types as T
    schema = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    rows = docs.select(*[f.name for f in fields], F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(run, schema)


def digests(docs: DataFrame, model: str, end_id: int | None = 2, text: str = "text", key: str = "doc_id",
            with_ids: bool = False, kept: int = UNITS_KEPT) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 (and ids, an array): the digests of
    ``encode_documents``, made in the same task so that decoded texts don't leave Python.
    ``kept``: units that a worker remembers in each generation (a choice of memory, never of results)."""
    out = pa.schema([(key, pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()),
                     *([("ids", pa.list_(pa.int32()))] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(model, kept)
        tail = np.array([] if end_id is None else [end_id], dtype=np.int32)
        for batch in slices(batches, "_text"):
            n, ids_sha, text_sha, every = [], [], [], []
            for t in column(batch, "_text").to_pylist():
                ids = np.concatenate((table.encode(t or ""), tail))
                n.append(len(ids))
                if with_ids:
                    every.append(ids)
                ids_sha.append(hashlib.sha256(" ".join(table.number[ids].tolist()).encode()).hexdigest())
                text_sha.append(hashlib.sha256(table.decode(ids).encode("utf-8")).hexdigest())
            yield batch_of(out, [column(batch, key), n, ids_sha, text_sha, *([every] if with_ids else [])])

    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(run, f"`{key}` long, n_tokens long, ids_sha256 string, decoded_sha256 string"
                            + (", ids array<int>" if with_ids else ""))


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Registered query: digests of the ids and of the decoded text of every document."""
    import public_tokenizers

    from .common import table
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def sentencepiece_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: doc_id, n_tokens, the digests and the ids of every document."""
    import public_tokenizers

    from .common import collected
    collected(spark)
    return digests(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True, kept=PIPELINE_UNITS_KEPT)
