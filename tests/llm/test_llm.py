"""The operators of the llm subpackage against brute force, round trips, held-out accuracy and edge cases."""
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, n long, id long, a long, part int"


def frame(spark, rows, parts=3):
    """Documents with extra columns whose names clash with working columns."""
    full = [(k, t, lang, src, None if t is None else len(t), 0.5, 7, 8, 9, 10) for k, t, lang, src in rows]
    return spark.createDataFrame(full, DOCS).repartition(parts)


def words(rng, n, size=40):
    return " ".join(rng.choice(["ba", "do", "ki", "lu", "me", "no", "pa", "ri", "so", "tu"]) + rng.choice("aeioulnrst") * rng.randrange(1, 3)
                    + str(rng.randrange(size)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Nulls in every column, empty and blank texts, very long ones, repeated rows, copies, near copies, ties."""
    rng = random.Random(3)
    rows = [(None, "a text without a key\nand a second line", "en", "s"), (1, None, None, None), (2, "", "en", "s"), (3, " \n\t\n", None, "s"),
            (4, "one", "de", None), (5, "two words", "de", "t"), (6, words(rng, 20_000), "en", "s"), (7, "no letters: 1234 !!! 567", "en", "s")]
    for i in range(10, 50):
        rows.append((i, "\n".join(words(rng, rng.randrange(3, 60)) for _ in range(rng.randrange(1, 6))), rng.choice(["en", "de", "fr"]), rng.choice("st")))
    base = words(rng, 150, 10_000).split()
    for i in range(50, 70):  # near copies with 0 to 9 changed words
        w = list(base)
        for _ in range((i - 50) // 2):
            w[rng.randrange(len(w))] = "changed" + str(rng.randrange(1000))
        rows.append((i, "\n".join(" ".join(w[j:j + 30]) for j in range(0, 150, 30)), "en", "s"))
    rows += [(80 + i, rows[10][1], "en", "s") for i in range(5)]  # exact copies
    rows += [rows[12], rows[12]]  # repeated rows
    return rows


# ---- op5, op8 ---------------------------------------------------------------------------------

def odd_texts():
    rng = random.Random(5)
    alphabet = ["a", "b", " ", " ", "  ", "é", "\n", "\t", " ", "　", "€", "😀", "<s>", "</s>", "0", "123", "th", "the", ". ", "\xa0", "\r", "▁",
                "中文", "\x00", "<0x41>", "'s", "ñ", "ß", "loser", "\n\n", "。", "²", "…"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 25))) for _ in range(4000)] + ["", " ", "x" * 3000, "ab " * 3000]


def test_piece_table_equals_the_library():
    import sentencepiece
    from logloom.llm.op5_sentencepiece import PieceTable
    path = public_tokenizers.path("piece_bpe_32k.model")
    ours, lib = PieceTable(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for text in odd_texts():
        ids = lib.encode(text)
        assert ours.encode(text).tolist() == ids, text
        assert ours.decode(ids + [2]) == lib.decode(ids + [2]), text
    rng = random.Random(1)
    for _ in range(2000):  # any ids, not only encodings
        ids = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randrange(0, 12))]
        assert ours.decode(ids) == lib.decode(ids), ids


def test_piece_table_forgets(monkeypatch):
    from logloom.llm import op5_sentencepiece as op
    monkeypatch.setattr(op, "UNITS_KEPT", 3)
    monkeypatch.setattr(op, "PAIRS_KEPT", 3)
    path = public_tokenizers.path("piece_bpe_32k.model")
    few, many = op.PieceTable(path), op.PieceTable(path)
    text = "the cat sat on the mat and the dog saw the cat, and the mat."
    assert few.encode(text).tolist() == few.encode(text).tolist() == many.encode(text).tolist()


def test_op5_rows(spark, corpus):
    import sentencepiece
    from logloom.llm.op5_sentencepiece import digests, encode_documents
    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = frame(spark, corpus)
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digests(docs, path).collect())
    want = []
    for k, t, _, _ in corpus:
        ids = lib.encode(t or "") + [2]
        want.append((str(k), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    assert got == sorted(want)
    rows = encode_documents(docs, path, keep=("doc_id", "score")).collect()
    assert all(r.score == 0.5 and r.decoded == lib.decode(r.ids) for r in rows) and len(rows) == len(corpus)
    assert digests(docs.limit(0), path).count() == 0


def test_unit_encoder_equals_the_library():
    from tokenizers import Tokenizer
    from logloom.llm.op8_token_files import UnitEncoder
    path = public_tokenizers.path("byte_bpe_50k.json")
    ours, lib = UnitEncoder(path, "<u2"), Tokenizer.from_file(path)
    texts = odd_texts() + ["a<|endoftext|> b", "plain words here.\nNext line, and more!", "ends here. "]
    for lo in range(0, len(texts), 300):
        some = texts[lo:lo + 300]
        for text, ids in zip(some, ours.encode(some)):
            assert np.frombuffer(ids, "<u2").tolist() == lib.encode(text, add_special_tokens=False).ids, text


def test_op8_files(spark, corpus, tmp_path):
    from tokenizers import Tokenizer
    from logloom.llm.op8_token_files import TokenFile, read_files, write_files
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    manifest = write_files(frame(spark, corpus), str(tmp_path / "out"), path, 2, 50_257, parts=4)
    got = sorted(((-1 if r.key is None else r.key), r.start, r.n_tokens, r.ids_crc32) for r in read_files(manifest).collect())
    ids = [((-1 if k is None else k), lib.encode(t or "", add_special_tokens=False).ids + [2]) for k, t, _, _ in corpus]
    at, want = 0, []
    for k, i in sorted(ids, key=lambda x: (x[0], np.array(x[1], "<u2").tobytes())):
        want.append((k, at, len(i), zlib.crc32(np.array(i, "<u4").tobytes())))
        at += len(i)
    assert got == sorted(want)
    parts = manifest.orderBy("part").collect()
    assert [p.base for p in parts] == [sum(q.tokens for q in parts[:i]) for i in range(len(parts))]
    flat = np.concatenate([np.memmap(p.path + ".bin", dtype=p.dtype, mode="r") for p in parts])
    assert flat.tolist() == [x for _, i in sorted(ids, key=lambda x: (x[0], np.array(x[1], "<u2").tobytes())) for x in i]
    assert len(TokenFile(parts[0].path, parts[0].dtype)) == parts[0].documents
    assert read_files(write_files(frame(spark, corpus).limit(0), str(tmp_path / "none"), path, 2, 50_257)).count() == 0
    wide = write_files(frame(spark, corpus[:3]), str(tmp_path / "wide"), path, 2, 100_000, parts=1).collect()
    assert wide[0].dtype == "<u4"


# ---- op10 -------------------------------------------------------------------------------------

def brute_components(texts):
    """texts: {key: text}. (size, component) by comparing all pairs."""
    sets = {}
    for k, t in texts.items():
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[k] = frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    keys = sorted(sets)
    for i, x in enumerate(keys):
        for y in keys[:i]:
            a, b = sets[x], sets[y]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[max(find(x), find(y))] = min(find(x), find(y))
    return {k: (len(sets[k]), find(k)) for k in sets}


def test_op10_against_all_pairs(spark, corpus):
    from logloom.llm.op10_ngram_join import component_ids, ngram_stage
    docs = frame(spark, corpus)
    got = component_ids(docs).collect()
    want = brute_components({k: t for k, t, _, _ in corpus if k is not None})
    assert sorted((r.k, r.n_shingles, r.component_id) for r in got if r.k is not None) == sorted((k, *want[k]) for k, _, _, _ in corpus if k is not None)
    assert [r.component_id for r in got if r.k is None] == [None]
    kept = ngram_stage(spark, docs, None)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k in want if want[k][1] == k} | {None}
    assert component_ids(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n,deletions", [(6, True), (6, False), (30, True), (30, False), (120, False)])
def test_op10_every_link_at_any_plan(spark, monkeypatch, n, deletions):
    """Chains of sets around the threshold, with single segments and with one-deletion neighbourhoods."""
    from logloom.llm import op10_ngram_join as op

    def plan(band, classes):
        need = 2 * (int(op.EDGES[band + 1]) - 1) // 9 + 1
        return (math.ceil(need / 2), True) if deletions else (need + 3, False)
    monkeypatch.setattr(op, "plan", plan)
    rng, rows = random.Random(n), []
    for g in range(6):
        w = [f"w{rng.randrange(10**6)}" for _ in range(n + 4)]
        for i in range(8):
            rows.append((100 * g + i, " ".join(w), "en", "s"))
            w = list(w)
            if rng.random() < 0.5:
                w[rng.choice([0, -1, rng.randrange(len(w))])] = f"x{rng.randrange(10**6)}"
            else:
                w = w[1:] if rng.random() < 0.5 else w + [f"y{rng.randrange(10**6)}"]
    got = op.component_ids(frame(spark, rows)).collect()
    want = brute_components({k: t for k, t, _, _ in rows})
    assert sorted((r.k, r.n_shingles, r.component_id) for r in got) == sorted((k, *v) for k, v in want.items())


def test_op10_plan_is_by_cost():
    from logloom.llm import op10_ngram_join as op
    for band in range(1, 12):
        need = 2 * (int(op.EDGES[band + 1]) - 1) // 9 + 1
        for classes in (1, 1000, 10**9):
            segments, deletions = op.plan(band, classes)
            assert segments * (2 if deletions else 1) >= need
    kinds = {op.plan(b, c)[1] for b in range(1, 10) for c in (1, 10**6)}
    assert kinds == {True, False}


# ---- op4, components --------------------------------------------------------------------------

def test_components(spark):
    from logloom.llm.components import components
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(5, x) for x in range(200, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        if a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if any(x in (a, b) and a != b for a, b in links)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_lines(rows):
    """The texts that remain when only the first line of each component of similar lines stays."""
    white = " \t\r\f\x0b"
    order = lambda k: (k is None, k or 0)
    places = {}
    for k, t, _, _ in rows:
        for i, line in enumerate((t or "").split("\n")):
            if line.strip(white):
                places.setdefault(line, []).append((order(k), i))
    found = list(places)
    sets = [{x[i:i + 8] for i in range(max(1, len(x) - 7))} for x in found]
    root = list(range(len(found)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (m := len(a & b)) and m >= 0.8 * (len(a) + len(b) - m):
                root[find(i)] = find(j)
    first = {}
    for i, line in enumerate(found):
        r = find(i)
        first[r] = min(first.get(r, min(places[line])), min(places[line]))
    stay = set(first.values())
    return [(k, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if not x.strip(white) or (order(k), i) in stay)) for k, t, _, _ in rows]


def test_op4_against_all_pairs(spark, corpus):
    from logloom.llm.op4_line_dedup import dedup, line_dedup_stage
    rows = corpus + [(300, "a line that is quite long and nearly the same as another one", "en", "s"), (301, "A line that is quite long and nearly the same as another one\n\nshort\nshort", "en", "s"),
             (302, "short", "en", "s"), (303, "tiny\n" + "lang " * 4000, "en", "s"), (304, "lang " * 4001 + "\ntinz", "en", "s")]
    docs = frame(spark, rows)
    out = dedup(docs)
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.text or "", r.text is None) for r in out.collect())
    assert got == sorted(((k is None, k or 0), t or "", t is None) for k, t in brute_lines(rows))
    assert [c for c in out.columns if not c.startswith("_")] == docs.columns
    assert dedup(docs.limit(0)).count() == 0
    kept = {r.doc_id for r in line_dedup_stage(spark, docs, None).collect()}
    assert {1, 2, 3, 300} <= kept and 302 not in kept and 301 in kept


def test_op4_rows_that_share_a_key_lose_only_their_own_lines(spark):
    from logloom.llm.op4_line_dedup import dedup, line_dedup_stage
    rows = [(1, "the line that many documents repeat", "en", "s"),
            (None, "the line that many documents repeat\nwords of the first row alone", "en", "s"), (None, "only the second row says this sentence\nand goes on with other matters", "en", "s"),
            (5, "the line that many documents repeat", "en", "s"), (5, "quite another subject in the row of equal key", "en", "s")]
    want = sorted([rows[0][:2], (None, "words of the first row alone"), rows[2][:2], (5, ""), rows[4][:2]], key=str)
    assert sorted(((r.doc_id, r.text) for r in dedup(frame(spark, rows)).collect()), key=str) == want
    kept = line_dedup_stage(spark, frame(spark, rows), None).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == [x for x in want if x[1]]


def test_op4_group_of_lines_that_are_alike_but_not_enough(spark):
    """A template with different words in it, some of whose lines are near copies of each other; all links are found."""
    from logloom.llm.op4_line_dedup import dedup
    rng = random.Random(11)
    base = "the same long beginning of every line in this group and then some more of it %s and an end that they share %s %s"
    text = lambda: base % tuple("".join(rng.choice("abcdefghij") for _ in range(14)) for _ in range(3))
    rows = [(i, text(), "en", "s") for i in range(150)]
    rows += [(200 + i, rows[i][1][:-2] + "zz", "en", "s") for i in range(0, 150, 3)]
    got = sorted((r.doc_id, r.text) for r in dedup(frame(spark, rows)).collect())
    assert got == sorted(brute_lines(rows)) and sum(t == "" for _, t in got) == 50


def test_op4_recall_by_line_length(spark):
    """Pairs just above the threshold, far apart from all others: nearly all of them are found, at every length."""
    from logloom.llm.op4_line_dedup import dedup
    rng = random.Random(12)
    for length in (17, 30, 60, 200):
        rows = []
        for i in range(120):
            line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(length))
            sets = lambda x: {x[j:j + 8] for j in range(len(x) - 7)}
            cut = next(c for c in range(length - 1, 0, -1) if len(sets(line[:c])) / len(sets(line)) < 0.8) + 1
            rows += [(2 * i, line, "en", "s"), (2 * i + 1, line[:cut], "en", "s")]
        lost = sum(r.text == "" for r in dedup(frame(spark, rows)).collect())
        assert lost >= 0.9 * 120, length


@pytest.mark.parametrize("stage", ["toxicity", "line_dedup", "ngram_join", "mixing"])
def test_stages_leave_columns_with_clashing_names(spark, stage, monkeypatch):
    """Columns named as the stages' own working columns come through as they went in."""
    import corpus_pipeline
    from logloom.llm import op2_toxicity
    names = ["_tokens", "_dim0", "_dim1", "_dim2", "_probability", "_had", "_lines", "_kept", "_doc", "_t1", "_t2", "_places", "k", "score", "_text",
             "predicted", "evidence", "key", "text_", "id", "root", "others", "weight", "a.b", "c0"]
    docs = frame(spark, [(i, f"document {i} has these words of its own: w{i} x{i} y{i} z{i}", "en", "s") for i in range(20)])
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.concat(F.lit(n + " of "), F.col("doc_id").cast("string")).alias(n) for n in names])
    if stage == "toxicity":
        monkeypatch.setattr(op2_toxicity, "table", lambda s, d, n: s.createDataFrame([(i, 0, i % 2) for i in range(20)], "doc_id long, quality int, toxic int"))
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, None)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows or stage == "toxicity"
    assert all(r[n] == f"{n} of {r.doc_id}" for r in rows for n in names)


def test_op4_shingles_as_sets():
    """Hashes stand for the shingles of whole lines, short, empty and very long ones too, and pairs are measured exactly."""
    from logloom.llm.op4_line_dedup import BANDS, COUNTERS, SPARE, band_keys, prefixes, shared_shingles, shingle_hashes
    rng = random.Random(13)
    some = ["".join(rng.choice("ab \U0001f600") for _ in range(rng.choice((1, 5, 7, 8, 9, 30, 400)))) for _ in range(200)]
    some += ["", "x\0y", "\0" * 3, "\0" * 20, "ab" * 40_000]
    cut = lambda x: [x[i:i + 8] for i in range(max(1, len(x) - 7))]
    h, n = shingle_hashes(some)
    assert n.tolist() == [len(cut(x)) for x in some]
    named = {}
    assert all(named.setdefault(s, v) == v for s, v in zip((s for x in some for s in cut(x)), h.tolist()))
    assert len(set(named.values())) == len(named)
    got = [x.tolist() for x in shared_shingles(some, some[::-1])]
    sets = [set(cut(x)) for x in some]
    assert got == [[len(x) for x in sets], [len(x) for x in sets[::-1]], [len(x & y) for x, y in zip(sets, sets[::-1])]]
    rarity = np.random.default_rng(5).integers(0, 9, COUNTERS)
    line, x, size = prefixes(some, rarity)
    assert size.tolist() == [len(s) for s in sets]
    for i, s in enumerate(sets):
        whole = sorted({v % (1 << 64) for v in map(named.get, s)}, key=lambda v: (rarity[v % COUNTERS], v))
        assert (x[line == i].view(np.uint64)).tolist() == whole[:len(s) - -(-8 * len(s) // 10) + 1 + len(s) // SPARE]
    alone = [band_keys([x])[:, 0].tolist() for x in some]
    assert band_keys(some).T.tolist() == alone and all(len(k) == BANDS for k in alone)


# ---- op2, op7, op9 ----------------------------------------------------------------------------

def fold(k):
    return zlib.crc32(str(k).encode()) % 4


@pytest.fixture(scope="module")
def toxic_rows():
    rng, rows, labels = random.Random(8), [], []
    for k in range(600):
        toxic = k % 8 == 0
        w = words(rng, rng.randrange(5, 120)).split()
        if toxic:
            for _ in range(rng.randrange(1, 5)):
                w.insert(rng.randrange(len(w)), rng.choice(["vileword", "Nastyword,", "foulstemxa", "foulstemyo"]))
        rows.append((k, " ".join(w), "en", "s"))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def test_op2_nearest_is_exact(spark, toxic_rows):
    from logloom.llm.op2_toxicity import NEIGHBOURS, train
    rows, labels = toxic_rows
    index = train(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    dense = np.zeros((len(index.keys), len(index.place)))
    term = np.searchsorted(index.ptr, np.arange(len(index.row)), side="right") - 1
    dense[index.row, term // index.blocks] = index.weight
    for _, t, _, _ in rows[::7]:
        at, w = index.vector(t)
        q = np.zeros(len(index.place))
        q[at] = w
        cos = np.round(dense @ q, 12)
        best = [i for i in np.lexsort((index.keys, -cos)) if cos[i] > 0][:NEIGHBOURS]
        got, c = index.nearest(at, w)
        assert index.keys[got].tolist() == index.keys[best].tolist() and np.allclose(c, cos[best])


def test_op2_held_out(spark, toxic_rows, corpus):
    from logloom.llm.op2_toxicity import score, train
    rows, labels = toxic_rows
    lab = spark.createDataFrame(labels + [(None, 1, 1), (5000, 1, 1), (3, 1, None), (9, 1, 0), (9, 1, 1)], "doc_id long, quality int, toxic int")
    index = train(frame(spark, rows), lab)
    assert all(fold(k) != 2 for k in index.keys.tolist()) and 9 not in index.keys
    got = {r.doc_id: r for r in score(frame(spark, rows), index).collect()}
    held = [(got[k], t) for k, _, t in labels if fold(k) == 2]
    assert sum(r.predicted != t for r, t in held) <= 0.03 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    odd = score(frame(spark, corpus), index, keep=("n",)).collect()
    assert len(odd) == len(corpus) and all(r.n == 7 for r in odd) and next(r for r in odd if r.doc_id == 1).evidence == []
    assert train(frame(spark, rows), lab.limit(0)) is None and train(frame(spark, rows).limit(0), lab) is None
    assert {r.score for r in score(frame(spark, corpus), None).collect()} == {0.0}
    assert score(frame(spark, corpus).limit(0), index).count() == 0


def brute_statistics(t):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", t or "") if x]
    three = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    repeat = {j for i in range(len(w) - 2) if three[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), dup, len(repeat)


def test_op7_statistics(spark, corpus):
    from logloom.llm.op7_quality_rules import NO_TREES, judge, repeated_words, statistics
    rng = random.Random(4)
    texts = [t for _, t, _, _ in corpus] + ["".join(rng.choice(["a ", "b ", "c\n", "a b c ", "#", "é\t", " ", "\r", "x\n"]) for _ in range(rng.randrange(60))) for _ in range(500)]
    for t in texts:
        assert statistics(t)[0] == brute_statistics(t), t
    numbers = np.array([5, 1, 2, 3, 1, 2, 3, 9])
    assert repeated_words(numbers, 10) == repeated_words(numbers, 1 << 21) == 6
    got = judge(frame(spark, corpus), NO_TREES).collect()
    assert len(got) == len(corpus)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept == (not r.base_failed)
    assert judge(frame(spark, corpus).limit(0), NO_TREES).count() == 0


def test_op7_trees():
    from logloom.llm.op7_quality_rules import FEATURES, fit_trees
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(FEATURES)))
    directions = list(FEATURES.values())
    y = ((x[:, 2] + 0.3 * np.sin(9 * x[:, 0]) < 0.6) ^ (rng.random(3000) < 0.05)).astype(float)
    trees = fit_trees(x, y, directions)
    score = trees.score(x)
    assert ((score > 0) == y).mean() > 0.9
    for j, d in enumerate(directions):
        if d:  # moving a constrained feature never moves the score the wrong way
            more = x[:300].copy()
            more[:, j] += rng.random(300)
            assert (d * (trees.score(more) - trees.score(x[:300])) >= -1e-9).all()

    def walk(row):  # the flat arrays, node by node
        total = trees.start
        for node in trees.roots:
            while trees.left[node] != node:
                node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
            total += trees.value[node]
        return total
    assert np.allclose([walk(r) for r in x[:50]], score[:50])


def test_op7_and_op9_held_out(spark, sf):
    from logloom.llm.op7_quality_rules import op7_quality_rules
    from logloom.llm.op9_language import op9_language
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op9_language(spark, sf).collect()
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in got if r.held_out]) > 0.95
    assert all(0 <= r.score <= 1 and r.held_out == (fold(r.doc_id) == 2) for r in got)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in op7_quality_rules(spark, sf).collect() if r.doc_id in quality and not r.base_failed]
    assert np.mean([r.kept == quality[r.doc_id] for r in rows]) > 0.9


def test_op9_edges(spark, corpus):
    from logloom.llm.op9_language import predict, train
    docs = frame(spark, corpus)
    model = train(docs)
    got = predict(docs, model).collect()
    assert len(got) == len(corpus)
    for r in got:
        text = next(t for k, t, _, _ in corpus if k == r.doc_id)
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
    assert {r.lang_pred for r in predict(docs, train(docs.limit(0))).collect()} == {"und"}
    assert predict(docs.limit(0), model).count() == 0


# ---- op1, op3, op6 ----------------------------------------------------------------------------

def test_op1_rules(spark, corpus):
    from logloom.llm.op1_licenses import scan, sentences
    apache = ("Copyright 2020 A. Person\nLicensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.\n"
              "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0\n")
    rows = corpus + [(900, "x\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.", None, None), (901, apache, None, None),
                     (902, "This licence is unknown to all. Released under the MIT License. Released under the MIT License.", None, None),
                     (903, "Redistributions of source code must retain the above copyright notice, this list.", None, None),
                     (904, "THIS WORK IS LICENSED under the GNU General Public License, version 3.", None, None), (None, "SPDX-License-Identifier: MIT", None, None)]
    got = {r.doc_id: (r.identifiers, r.licenses, r.n_unmatched, r.copyrights) for r in scan(frame(spark, rows)).collect()}
    assert got == {900: ("MitShort CcByNc", "MIT,CC-BY-NC-4.0", 0, 0), 901: ("Copyright ApacheLicensed ApacheUse ApacheCopy", "Apache-2.0", 2, 1),
                   902: ("Unknown MitShort MitShort", "MIT", 1, 0), 903: ("BsdSource", "", 1, 0), 904: ("GplShort3", "GPL-3.0", 0, 0), None: ("SpdxMit", "MIT", 0, 0)}
    assert "_sentence" in sentences(frame(spark, rows)).columns and scan(frame(spark, rows).limit(0)).count() == 0


WRAPPED = {
    "MIT": """The MIT License (MIT)

Copyright (c) 2020 A Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
""",
    "Apache-2.0": """Copyright 2020 Some Person

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
""",
    "BSD-3-Clause": """Copyright (c) 2020, A Person
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above
   copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
""",
    "GPL-2.0": """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License along
with this program; if not, write to the Free Software Foundation, Inc.,
51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.
""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED.
""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""}
WRAPPED["BSD-2-Clause"] = "\n".join(x for x in WRAPPED["BSD-3-Clause"].split("\n") if not re.match("3. Nei|   contributors|   this software", x))


def test_op1_wrapped_notices(spark):
    from logloom.llm.op1_licenses import scan
    styles = [("", ""), ("# ", "#!/bin/sh\n# a tool\n"), (" * ", "/*\n"), ("// ", ""), (";; ", ""), ("dnl ", "")]
    cases, rows = [], []
    for name, text in WRAPPED.items():
        for leader, before in styles:
            cases.append(name)
            rows.append((len(rows), before + "\n".join((leader + x).rstrip() for x in text.strip().split("\n")) + "\nint main\n", "en", "s"))
        cases.append(name)  # each paragraph on one line
        rows.append((len(rows), "\n\n".join(re.sub(" *\n *(?!\\d\\.)", " ", x) for x in text.split("\n\n")), "en", "s"))
    ends = ["Redistributions of source code must retain the above copyright notice\nCopyright 2020 X\nReleased under the MIT License.\n",
            "The software is provided as is, without warranty of any kind at all\nIn no event shall the authors or copyright holders be liable for any claim, damages or other liability whatever\n\nthis license is unknown\nas is that licence"]
    rows += [(1000 + i, t, "en", "s") for i, t in enumerate(ends)]
    got = {r.doc_id: r for r in scan(frame(spark, rows)).collect()}
    for i, name in enumerate(cases):
        assert got[i].licenses == name and got[i].n_unmatched == (name == "MIT" and "Unknown" in got[i].identifiers), (rows[i][1], got[i])
    assert (got[1000].identifiers, got[1000].licenses) == ("Unknown Copyright MitShort", "MIT")
    assert got[1001].identifiers == "MitAsIs MitLiable Unknown Unknown"


def test_op3_meets_targets(spark, corpus):
    from logloom.llm.op3_mixing import mix, probabilities, rake, topic
    rng = random.Random(6)
    cells = [(s, l, t, rng.randrange(1, 2000), 1) for s in "abcd" for l in ("en", "de", None) for t in ("x", "y")] + [("e", "fr", "x", 0, 4)]
    table = spark.createDataFrame(cells, "s string, l string, t string, tokens long, documents long")
    wishes = {"s": 0.5, "l": {"en": 0.3, "de": 0.6}, "t": {"x": 0.5, "y": 0.5, "absent": 3.0}}
    out = rake(table, wishes).collect()
    by = lambda d: {v: sum(r.weight for r in out if r[d] == v) for v in {r[d] for r in out}}
    assert by("t")["x"] == pytest.approx(0.5, abs=1e-6) and by("l")["de"] == pytest.approx(0.6, abs=1e-3) and by("l")[None] == pytest.approx(0.1, abs=1e-3)
    assert sum(r.weight for r in out) == pytest.approx(1)
    p = probabilities(rake(table, wishes), 0.4).collect()
    assert sum(r.probability * r.tokens for r in p) == pytest.approx(0.4 * sum(r.tokens for r in p), rel=1e-6)
    assert all(0 <= r.probability <= 1 for r in p) and next(r for r in p if r.tokens == 0).probability == 1
    docs = frame(spark, corpus)
    args = dict(targets={"source": 0.5, "lang": {"en": 0.5}, "topic": 1.0}, share=0.5, dims={"topic": topic(F.col("text"))})
    kept = mix(docs, **args).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(r.doc_id) for r in mix(docs.repartition(7), **args).collect())
    assert all(0 < r._probability <= 1 and r.score == 0.5 for r in kept) and mix(docs.limit(0), **args).count() == 0


def test_op3_keeps_values_without_a_target(spark):
    from logloom.llm.op3_mixing import TARGETS, _mixed, rake
    rng = random.Random(9)
    rows = [(i, words(rng, 30), ["en", "de", "fr", "es", "it", None][i % 6], "st"[i % 2]) for i in range(300)]
    rows += [(300 + i, words(rng, 30), None, "none") for i in range(60)] + [(400 + i, words(rng, 30), "it", "it") for i in range(60)]
    kept = collections.Counter((r.lang, r.source) for r in _mixed(frame(spark, rows)).collect())
    assert set(kept) == {(lang, src) for _, _, lang, src in rows}
    cells = [(s, l, "prose", 1000, 1) for s in "ab" for l in ("en", "de", "fr", "es", "it", None)]
    out = rake(spark.createDataFrame(cells, "source string, lang string, topic string, tokens long, documents long"), TARGETS).collect()
    by = {l: sum(r.weight for r in out if r.lang == l) for l in ("en", "de", "fr", "es", "it", None)}
    assert by == pytest.approx({"en": 1 / 3, "de": 0.4 / 3, "fr": 0.4 / 3, "es": 0.2 / 3, "it": 1 / 6, None: 1 / 6})
    only = rake(spark.createDataFrame([c for c in cells if c[1] in ("it", None)], "source string, lang string, topic string, tokens long, documents long"), TARGETS).collect()
    assert [r.weight for r in only] == pytest.approx([0.25] * 4)


def test_op6_against_brute_force(spark):
    from logloom.llm import op6_exact_topk as op
    rng = np.random.default_rng(1)
    v = {i: (np.round(rng.normal(size=6), 1) if i % 3 else rng.normal(size=6) * 3).tolist() for i in range(300)}
    v[7] = v[8] = v[9]
    v[20] = v[20][:4]
    rows = list(v.items()) + [(400, None), (401, [1.0, None]), (402, [float("nan")] * 6), (403, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (9, v[9])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).repartition(4)
    ints = {i: [math.floor(256 * x) for x in e] + [0] * (6 - len(e)) for i, e in v.items()}
    want = []
    for q in [i for i in ints if i % 10 == 0]:
        s = sorted((-sum(a * b for a, b in zip(ints[q], ints[i])), i) for i in ints if i != q)[:5]
        want += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    for pivots, block, team in ((64, 32768, 2048), (3, 40, 4)):
        op.QUERIES_PER_PIVOT, op.BLOCK, op.TEAM = pivots, block, team
        got = sorted(map(tuple, op.top_k(vectors, 5, F.col("vec_id") % 10 == 0).collect()))
        assert got == sorted(want)
    op.QUERIES_PER_PIVOT, op.BLOCK, op.TEAM = 64, 32768, 2048
    assert op.top_k(vectors.limit(0), 5, F.col("vec_id") % 10 == 0).count() == 0
    few = vectors.where("vec_id in (10, 11, 12)")
    assert few.count() == 3 and op.top_k(few, 5, F.col("vec_id") == 10).count() == 2


def test_pipeline(spark, sf):
    import corpus_pipeline
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "mixing", "sentencepiece"]
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and out.select("doc_id").distinct().count() == out.count()
