"""Conversation structure repair by weighted CYK interval parsing.

A conversation should read as an optional system turn and then user and
assistant turns in pairs, in role initials ``(s?(ua)+)?``.  Each row may be
kept (0), given the role user or assistant (2) or deleted (3, the only choice
for blank rows and for rows whose role and text came before), and empty user
or assistant turns may be inserted anywhere (2); a row that stays and does not
end in ``.``, ``!`` or ``?`` adds 1.  The edits' initials (K, R, D, I) in order
are the audit; of the cheapest edits the ASCII-least audit wins.

The grammar is in Chomsky normal form.  A nonterminal says with which role a
span begins and ends (``UA``: user .. assistant; ``SA`` begins with the system
turn; ``E``: nothing is left of the span), and every rule A -> B C joins two
spans whose inner roles may follow each other.  A cell holds, for each
nonterminal, the minimum (cost, audit); the cells of single rows are closed
under insertions before and after the row, and longer spans are combined
bottom-up by length over all their splits.  Of equal cost, no audit of a cell
is the beginning of another (it would differ by insertions only, and those cost
something), so the least audit of a joined span is made of least audits.

The rows are ranked by ranges (no task sees a whole conversation), the chart of
each block of ``BLOCK`` rows of a conversation is filled in one place, and
the cells of whole blocks are again spans, which are combined in further rounds
until each conversation is one span.  So a conversation of any length is spread
over tasks.  Only its audit (a letter a row) is one value of the result, and
the repaired turns are streamed in order, one row at a time.

Defined cases: null roles and texts are one space (so the text is blank, and
the role must change or go); a null key is a conversation of its own; turns
that are null come first, rows of equal turn are ordered by a hash of role and
text, and equal rows follow each other, the first of them being the original; equal 128-bit
hashes of role and text are taken for equal rows; empty texts are blank;
texts of any length are streamed and never cut; an empty table gives no rows;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, column, slices, table, written
from .ranks import ranked

#: Rows whose chart is filled at once, and spans that one further round combines.
BLOCK, FAN = 16, 16
#: Charts a worker remembers; they depend on the rows' codes only.
CHARTS_KEPT = 100_000

BLANKS = " \t\n\x0b\x0c\r"

# ---- the grammar --------------------------------------------------------------------------------

#: Nonterminals by the first and last role of what is left of a span.
NAMES = ["E", "UU", "UA", "AU", "AA", "S", "SU", "SA"]
START = ("E", "UA", "SA")
KEEP, CHANGE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1


def _rules() -> list[tuple[int, int, int]]:
    """(A, B, C) of every rule A -> B C."""
    number = {n: i for i, n in enumerate(NAMES)}
    out = []
    for b in NAMES:
        for c in NAMES:
            if b == "E" or c == "E":
                out.append((number[c if b == "E" else b], number[b], number[c]))
            elif c[0] != "S" and b[-1] + c[0] in ("SU", "UA", "AU"):
                out.append((number[b[0] + c[-1]], number[b], number[c]))
    return out


RULES = _rules()
Cell = list  # of (cost, audit) or None, by nonterminal
#: What insertions alone can give.
INSERTED: Cell = [None, (INSERT, "I"), (2 * INSERT, "II"), (2 * INSERT, "II"), (INSERT, "I"), None, None, None]


def _joined(left: Cell, right: Cell, into: Cell) -> bool:
    """Put what the rules make of two neighbouring spans into a cell, where it is less; whether it was."""
    less = False
    for a, b, c in RULES:
        x, y = left[b], right[c]
        if x is not None and y is not None:
            cost, old = x[0] + y[0], into[a]
            if old is None or cost < old[0] or (cost == old[0] and x[1] + y[1] < old[1]):
                into[a] = (cost, x[1] + y[1])
                less = True
    return less


def leaf(code: str) -> Cell:
    """The cell of one row, closed under insertions.  ``code``: role initial (s, u, a or x for any
    other) and fault (o none, t truncated, b blank, p repeats an earlier row)."""
    role, fault = code
    cell: Cell = [None] * len(NAMES)
    cell[0] = (DELETE, "D")
    if fault in "ot":
        more = TRUNCATED if fault == "t" else 0
        for name, initial in (("UU", "u"), ("AA", "a")):
            cell[NAMES.index(name)] = (KEEP + more, "K") if role == initial else (CHANGE + more, "R")
        if role == "s":
            cell[NAMES.index("S")] = (KEEP + more, "K")
    while _joined(INSERTED, list(cell), cell) | _joined(list(cell), INSERTED, cell):
        pass
    return cell


def combined(cells: list[Cell]) -> Cell:
    """The cell of the whole span: a chart over all intervals, by their length."""
    n = len(cells)
    chart = {(i, i + 1): c for i, c in enumerate(cells)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            cell: Cell = [None] * len(NAMES)
            for k in range(i + 1, i + length):
                _joined(chart[i, k], chart[k, i + length], cell)
            chart[i, i + length] = cell
    return chart[0, n]


class Charts:
    """Cells of row sequences by their codes, remembered."""

    def __init__(self):
        self.known: dict[str, Cell] = {}

    def cell(self, codes: str) -> Cell:
        """``codes``: two letters a row."""
        found = self.known.get(codes)
        if found is None:
            if len(self.known) > CHARTS_KEPT:
                self.known.clear()
            for length in range(1, len(codes) // 2 + 1):
                for i in range(0, len(codes) - 2 * length + 1, 2):
                    part = codes[i:i + 2 * length]
                    if part in self.known:
                        continue
                    if length == 1:
                        made = leaf(part)
                    else:
                        made = [None] * len(NAMES)
                        for k in range(2, 2 * length, 2):
                            _joined(self.known[part[:k]], self.known[part[k:]], made)
                    self.known[part] = made
            found = self.known[codes]
        return found


def cheapest(cell: Cell) -> tuple[int, str]:
    return min(cell[NAMES.index(n)] for n in START if cell[NAMES.index(n)] is not None)


# ---- rows, blocks, conversations ------------------------------------------------------------------

def _filled(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def _rows(conversations: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """key, turn, h1, h2 (of role and text), role, text: nulls filled."""
    rows = conversations.select(F.col(key).alias("key"), F.col(turn).cast("long").alias("turn"), _filled(role).alias("role"), _filled(text).alias("text"))
    return rows.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit("second"), "role", "text")})


def _codes(rows: DataFrame) -> DataFrame:
    """key, turn, code of every row, with its ``rank`` in the order of all rows."""
    body = F.rtrim("text", F.lit(BLANKS))
    initial = F.left("role", F.lit(1))
    facts = rows.select("key", "turn", "h1", "h2", F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("i"),
                        F.when(body == "", "b").when(F.right(body, F.lit(1)).isin(".", "!", "?"), "o").otherwise("t").alias("f"))
    # equal rows of a turn are one row until they are ranked; the first turn of each text holds the original
    facts = written(facts.groupBy("key", "turn", "h1", "h2", "i", "f").agg(F.count("*").alias("n")), "op13-facts")
    first = facts.groupBy(F.col("key").alias("k"), F.col("h1").alias("g1"), F.col("h2").alias("g2")).agg(
        F.min_by(F.struct("turn"), F.struct(F.col("turn").isNotNull(), "turn")).alias("t"))
    facts = facts.join(first, F.col("key").eqNullSafe(F.col("k")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")))
    original = F.col("turn").eqNullSafe(F.col("t.turn"))
    facts = facts.select("key", "turn", "h1", "h2", "i", "f", original.alias("o"), F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("c"))
    fault = F.when((F.col("f") != "b") & ~(F.col("o") & (F.col("c") == 1)), "p").otherwise(F.col("f"))
    facts = facts.select("key", "turn", "h1", "h2", "c", F.concat("i", fault).alias("code"))
    return ranked(facts, ["key", "turn", "h1", "h2", "c"], "rank").select("key", "turn", "code", "rank")


_CELL = "array<struct<cost:long,audit:string>>"
_SPAN = (f"cell {_CELL}, blank long, duplicate long, truncated long, illegal long, first string, last string, "
         "least long, most long, turns long")
_FOLLOWS = {"su", "ua", "au"}


def _block(codes: str, turns: list, charts: Charts) -> tuple:
    """The span of a block of rows."""
    initials, faults = codes[::2], codes[1::2]
    known = [t for t in turns if t is not None]
    return (charts.cell(codes), faults.count("b"), faults.count("p"), faults.count("t"),
            sum(initials[i:i + 2] not in _FOLLOWS for i in range(len(initials) - 1)), initials[0], initials[-1],
            known[0] if known else None, known[-1] if known else None, len(set(known)))


def _together(spans: list[dict]) -> tuple:
    """The span of neighbouring spans."""
    cells = [[None if x is None else (x["cost"], x["audit"]) for x in s["cell"]] for s in spans]
    illegal = sum(s["illegal"] for s in spans) + sum(a["last"] + b["first"] not in _FOLLOWS for a, b in zip(spans, spans[1:]))
    dated = [s for s in spans if s["turns"]]
    turns = sum(s["turns"] for s in dated) - sum(a["most"] == b["least"] for a, b in zip(dated, dated[1:]))
    return (combined(cells), *(sum(s[f] for s in spans) for f in ("blank", "duplicate", "truncated")), illegal, spans[0]["first"], spans[-1]["last"],
            dated[0]["least"] if dated else None, dated[-1]["most"] if dated else None, turns)


def _spans(blocks: DataFrame, kind: str, made) -> DataFrame:
    """Map (key, at, ..) to (key, at, span)."""
    schema = f"key {kind}, at long, {_SPAN}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        charts = Charts()
        for whole in batches:
            for batch in slices([whole], rows=1024):
                rows = batch.select([n for n in batch.schema.names if n != "key"]).to_pylist()
                found = [made(r, charts) for r in rows]
                cells = [[None if x is None else {"cost": x[0], "audit": x[1]} for x in f[0]] for f in found]
                typed = [pa.array(cells, pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())])))]
                for i in range(1, 10):
                    typed.append(pa.array([f[i] for f in found], pa.string() if i in (5, 6) else pa.int64()))
                yield pa.RecordBatch.from_arrays([column(batch, "key"), column(batch, "at"), *typed], names=["key", "at", *_NAMES])
    return blocks.mapInArrow(run, schema)


_NAMES = ["cell", "blank", "duplicate", "truncated", "illegal", "first", "last", "least", "most", "turns"]


def spans(rows: DataFrame) -> DataFrame:
    """(key, span): one whole span for each conversation of ``rows`` (see ``_rows``)."""
    kind = rows.schema["key"].dataType.simpleString()
    blocks = _codes(rows).groupBy("key", F.floor(F.col("rank") / BLOCK).cast("long").alias("at")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "code", "turn"))).alias("r"))  # BLOCK rows
    blocks = blocks.select("key", "at", F.array_join("r.code", "").alias("codes"), F.col("r.turn").alias("turns"))
    found = written(_spans(blocks, kind, lambda r, charts: _block(r["codes"], r["turns"], charts)), "op13-spans")
    while True:
        most = found.groupBy("key").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return found.drop("at")
        # a conversation of few spans is one group, whatever ranks it lies at
        group = F.lit(0).cast("long") if most <= FAN else F.floor(F.col("at") / FAN).cast("long")
        parts = found.groupBy("key", group.alias("g")).agg(F.array_sort(F.collect_list(F.struct("at", *_NAMES))).alias("r"))  # FAN spans
        parts = parts.select("key", F.col("g").alias("at"), "r")
        found = written(_spans(parts, kind, lambda r, charts: _together(r["r"])), "op13-spans")


def repairs(rows: DataFrame) -> DataFrame:
    """key, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation of ``rows``."""
    best = F.array_min(F.filter(F.array(*[F.col("cell")[NAMES.index(n)] for n in START]), lambda x: x.isNotNull()))
    gaps = F.when(F.col("turns") > 0, F.col("most") - F.col("least") + 1 - F.col("turns")).otherwise(0).cast("long")
    return spans(rows).select("key", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal",
                              best["cost"].alias("cost"), best["audit"].alias("audit"))


_FACTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
_TURNS = "place long, role string, text string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def repaired(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
             keys: DataFrame | None = None) -> DataFrame:
    """key, place, role, text, and what was found, of every conversation.

    Place 0 is the conversation itself, with gaps, blank, duplicate, truncated, illegal, cost and audit;
    places from 1 on are its repaired turns.  ``keys`` (a column ``key``) names further conversations,
    which have no rows.  The places of a conversation follow each other in one partition."""
    rows = _rows(conversations, key, turn, role, text)
    found = repairs(rows)
    heads = rows.select("key")
    if keys is not None:
        heads = heads.union(keys.select("key"))
    heads = heads.distinct().join(found.withColumnRenamed("key", "k"), F.col("key").eqNullSafe(F.col("k")), "left").drop("k")
    zero = [F.coalesce(F.col(c), F.lit("") if c == "audit" else F.lit(0).cast("long")).alias(c) for c in _FACTS]
    heads = heads.select("key", F.lit(0).alias("kind"), F.struct(*zero).alias("facts"), *[F.lit(None).cast(t).alias(c) for c, t in (
        ("turn", "long"), ("h1", "long"), ("h2", "long"), ("role", "string"), ("text", "string"))])
    facts = F.lit(None).cast(heads.schema["facts"].dataType)
    body = rows.select("key", F.lit(1).alias("kind"), facts.alias("facts"), "turn", "h1", "h2", "role", "text")
    kind = rows.schema["key"].dataType.simpleString()
    out_schema = f"key {kind}, {_TURNS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, place, last = "", 0, 0, ""
        out = None

        def next_role() -> str:
            return "assistant" if last == "u" else "user"

        for batch in slices(batches, "text", rows=1024):
            schema = pa.schema([pa.field("key", column(batch, "key").type), *_arrow_turns()])
            out = []
            for k, n, facts, r, t in zip(*(column(batch, c).to_pylist() for c in ("key", "kind", "facts", "role", "text"))):
                if n == 0:
                    audit, at, place, last = facts["audit"], 0, 0, ""
                    out.append((k, 0, None, None, *(facts[c] for c in _FACTS)))
                    edit = ""
                else:
                    edit = audit[at]
                    at += 1
                if edit in ("K", "R"):
                    name = r if edit == "K" else next_role()
                    last, place = name[:1], place + 1
                    out.append((k, place, name, t, *[None] * 7))
                while at < len(audit) and audit[at] == "I":
                    name = next_role()
                    last, place, at = name[:1], place + 1, at + 1
                    out.append((k, place, name, "", *[None] * 7))
            yield batch_of(schema, [list(c) for c in zip(*out)] if out else [[] for _ in schema])

    together = heads.union(body).repartition("key").sortWithinPartitions("key", "kind", "turn", "h1", "h2")
    return together.select("key", "kind", "facts", "role", "text").mapInArrow(run, out_schema)


def _arrow_turns() -> list[pa.Field]:
    return [pa.field("place", pa.int64()), pa.field("role", pa.string()), pa.field("text", pa.string()),
            *[pa.field(c, pa.string() if c == "audit" else pa.int64()) for c in _FACTS]]


def digests(turns: DataFrame) -> DataFrame:
    """Of the rows of ``repaired``: key, what was found, and the SHA-256 of the ``role:text`` of all
    repaired turns, joined by line breaks.  A conversation is hashed as it streams by."""
    kind = turns.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = digest = None
        for batch in slices(batches, "text", rows=4096):
            schema = pa.schema([pa.field("key", column(batch, "key").type), *[f for f in _arrow_turns() if f.name in _FACTS], pa.field("repaired_sha256", pa.string())])
            out = []
            for row in zip(*(column(batch, c).to_pylist() for c in ("key", "place", "role", "text", *_FACTS))):
                if row[1] == 0:
                    if head is not None:
                        out.append((*head, digest.hexdigest()))
                    head, digest = (row[0], *row[4:]), hashlib.sha256()
                else:
                    digest.update(f"{chr(10) if row[1] > 1 else ''}{row[2]}:{row[3]}".encode())
            if out:
                yield batch_of(schema, [list(c) for c in zip(*out)])
        if head is not None:
            yield batch_of(schema, [[c] for c in (*head, digest.hexdigest())])

    found = ", ".join(f"{c} {'string' if c == 'audit' else 'long'}" for c in _FACTS)
    return turns.mapInArrow(run, f"key {kind}, {found}, repaired_sha256 string")


# ---- the registered query -------------------------------------------------------------------------

def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that crc32 of ``conv_id:turn`` mod 20 names: 0 the row
    is dropped, 1 its text emptied, 2 its stops removed, 3 it is repeated, 4 its role is user."""
    rows = conversations.select("conv_id", "turn", _filled("role").alias("role"), _filled("text").alias("text"))
    number = F.crc32(F.encode(F.concat(_filled("conv_id"), F.lit(":"), _filled("turn")), "UTF-8")) % 20
    rows = rows.withColumn("n", number).where("n <> 0")
    text = F.when(F.col("n") == 1, "").when(F.col("n") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("n") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("n") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Registered query: every conversation of ``conversations`` after damage, its faults, the cheapest
    repair and the SHA-256 of the repaired turns."""
    conversations = table(spark, sf_dir, "conversations")
    turns = repaired(damaged(conversations), keys=conversations.select(F.col("conv_id").alias("key")))
    return digests(turns).withColumnRenamed("key", "conv_id")
