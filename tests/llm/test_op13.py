"""Conversation repair against a brute-force version."""
import functools
import hashlib
import random
import re
import sys
import zlib

from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string, key string, cost double, place long, rank long, code long, n long"
sys.setrecursionlimit(20_000)


def damage(rows):
    out = []
    for c, t, r, x in rows:
        r, x = (" " if v is None else v for v in (r, x))
        n = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if n == 0:
            continue
        if n == 1:
            x = ""
        if n == 2:
            x = re.sub("[.!?]", "", x)
        if n == 4:
            r = "user"
        out += [(c, t, r, x)] * (2 if n == 3 else 1)
    return out


def edits(rows):
    """Least (cost, audit) by deciding edit after edit from the left, over the states of s?(ua)+."""
    @functools.lru_cache(None)
    def best(i, state, inserted):
        found = []
        if i == len(rows) and state in ("", "a"):
            found.append((0, ""))
        nexts = {"": "u", "s": "u", "u": "a", "a": "u"}
        if inserted < 3:
            c, a = best(i, nexts[state], inserted + 1)
            found.append((c + 2, "I" + a))
        if i < len(rows):
            initial, fault = rows[i]
            c, a = best(i + 1, state, 0)
            found.append((c + 3, "D" + a))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if initial == nexts[state] or (initial == "s" and state == ""):
                    c, a = best(i + 1, initial, 0)
                    found.append((c + more, "K" + a))
                if initial != nexts[state]:
                    c, a = best(i + 1, nexts[state], 0)
                    found.append((c + 2 + more, "R" + a))
        return min(found, default=(10**9, ""))
    return best(0, "", 0)


def brute(conversations, rows):
    """rows after damage; conversations: all keys."""
    out = {}
    for c in conversations:
        mine = [r for r in rows if r[0] == c]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, faults = set(), []
        for _, _, r, x in mine:
            body = x.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not body else "duplicate" if (r, x) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((r, x))
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(mine, mine[1:])]
        cost, audit = edits(tuple((r[2][:1], f) for r, f in zip(mine, faults)))
        left, i, last = [], 0, ""
        for e in audit:
            follow = "assistant" if last == "u" else "user"
            if e == "I":
                left.append((follow, ""))
            else:
                if e == "K":
                    left.append(mine[i][2:])
                if e == "R":
                    left.append((follow, mine[i][3]))
                i += 1
            last = left[-1][0][0] if left else ""
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in left))
        text = "\n".join(f"{r}:{x}" for r, x in left)
        out[c] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs),
                  cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 0.5, 3, 4, 5, 6) for r in rows], SCHEMA).repartition(3)


def some(seed=1):
    rng = random.Random(seed)
    rows = []
    for c in [None, *range(60)]:
        for t in range(rng.randrange(1, 13)):
            rows.append((c, rng.choice([t, t, t, t + 3]) if rng.random() < 0.9 else None, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]),
                         rng.choice([None, "", " \t\n", "yes.", "no!", "open", "a text? ", "so\u00a0", "why?", "x" * 10, "long " * 20_000 + "."])))
    rows = list({(r[0], r[1]): r for r in rows}.values())  # one row a turn: the order of others is the operator's own
    rows += [r for r in rows if r[0] == 7]  # repeated rows
    rows += [(99, t, ["user", "assistant"][rng.randrange(5) % 2], f"turn {t}{rng.choice(['.', '', '!'])}") for t in range(700)]  # many blocks
    return rows


def got(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def test_query_equals_brute_force(spark, tmp_path):
    from logloom.llm.op13_conversation_repair import op13_conversation_repair
    rows = some()
    frame(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    found = op13_conversation_repair(spark, str(tmp_path))
    n = found.count()
    found = got(found)
    want = brute({r[0] for r in rows}, damage(rows))
    assert n == len(found) == len(want)
    for c in want:
        assert found[c] == want[c], c


def test_empty_and_dropped(spark, tmp_path):
    from logloom.llm.op13_conversation_repair import op13_conversation_repair
    gone = [c for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:2]
    frame(spark, [(c, 0, "user", "a.") for c in gone]).write.parquet(str(tmp_path / "conversations.parquet"))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got(op13_conversation_repair(spark, str(tmp_path))) == {c: empty for c in gone}
    frame(spark, []).write.parquet(str(tmp_path / "none/conversations.parquet"))
    assert op13_conversation_repair(spark, str(tmp_path / "none")).count() == 0


def test_repaired_turns(spark):
    from logloom.llm.op13_conversation_repair import repaired
    turns = repaired(frame(spark, [(1, 0, "assistant", "a."), (1, 1, "user", "b."), (1, 2, "system", "c.")]))
    rows = sorted((r.place, r.role, r.text, r.audit) for r in turns.where(F.col("place") > 0).collect())
    assert rows == [(1, "user", "", None), (2, "assistant", "a.", None), (3, "user", "b.", None), (4, "assistant", "c.", None)]
    head = turns.where(F.col("place") == 0).first()
    assert (head.cost, head.audit) == (4, "IKKR")


def test_combined_chart_equals_brute_force():
    from logloom.llm.op13_conversation_repair import Charts, cheapest, combined
    rng, charts = random.Random(4), Charts()
    names = {"o": "", "t": "truncated", "b": "blank", "p": "duplicate"}
    for _ in range(300):
        codes = [rng.choice("suax") + rng.choice("ooootbp") for _ in range(rng.randrange(1, 12))]
        want = edits(tuple((c[0], names[c[1]]) for c in codes))
        assert cheapest(charts.cell("".join(codes))) == want
        cut = rng.randrange(len(codes))
        parts = [charts.cell("".join(p)) for p in (codes[:cut], codes[cut:]) if p]
        assert cheapest(combined(parts)) == want
