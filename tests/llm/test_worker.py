"""What worker processes keep and get."""


def test_forget_drops_what_other_operators_keep():
    from logloom.llm.memory import forget, kept_by_worker
    made = []

    @kept_by_worker
    def table(name):
        made.append(name)
        return [name]

    assert table("a") is table("a") and made == ["a"]
    forget()
    assert table("a") == ["a"] and made == ["a", "a"]


def test_toxicity_sends_a_kept_text_once(spark):
    from logloom.llm.op2_toxicity import score
    rows = spark.createDataFrame([(1, "bad words"), (2, None), (3, "")], "doc_id long, text string")
    found = score(rows, None, keep=("doc_id", "text"))
    assert "_text" not in found._jdf.queryExecution().analyzed().toString()
    assert sorted((r.doc_id, r.text, r.score) for r in found.collect() if r.text is not None) == [(1, "bad words", 0.0), (3, "", 0.0)]
    assert score(rows, None).columns == ["doc_id", "score", "predicted", "evidence"]


def test_op5_encodes_no_run_anew_within_a_task_s_words(monkeypatch):
    """150,000 different words, met again, are looked up; what overflows keeps the newest run."""
    import public_tokenizers
    from logloom.llm import op5_sentencepiece as op
    table = op.PieceTable(public_tokenizers.path("piece_bpe_32k.model"))
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [letters[i % 26] + letters[i // 26 % 26] + letters[i // 676 % 26] + letters[i // 17576] for i in range(150_000)]
    text = " ".join(words)
    first = table.encode(text)
    asked = []
    monkeypatch.setattr(op.PieceTable, "ids_of", lambda self, unit, f=op.PieceTable.ids_of: asked.append(unit) or f(self, unit))
    assert table.encode(text).tolist() == first.tolist() and table.encode(text.replace(" ", ", ")).size > first.size
    assert asked == [","]
    monkeypatch.setattr(op, "UNITS_KEPT", 1)
    for _ in range(2):
        table.units.young, table.units.old = {}, {}
        table.encode("zzzzz")
    assert asked == [",", op.SPACE + "zzzzz"]


def test_op4_bitmaps_lose_no_link_and_few_pairs_leave_the_join(spark, monkeypatch):
    """300 lines that are alike, but not enough: their pairs end in the join; bits differ in as many places as sets at most."""
    import random

    import numpy as np
    from logloom.llm import op4_line_dedup as op
    rng = random.Random(21)
    base = "the same long beginning of every line in this group, then some more words of it and %s at an end that they share %s."
    text = lambda: base % tuple("".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(2))
    found = [text() for _ in range(300)]
    found += [x[:-3] + "zz." for x in found[:20]]
    n, bits = op.bitmaps([*found, "ab" * 30_000, "x"])
    sets = [{x[i:i + 8] for i in range(max(1, len(x) - 7))} for x in [*found, "ab" * 30_000, "x"]]
    assert n.tolist() == [len(s) for s in sets] and bits.shape == (len(n), op.WORDS)
    for i, j in ((rng.randrange(len(n)), rng.randrange(len(n))) for _ in range(300)):
        assert np.bitwise_count((bits[i] ^ bits[j]).view(np.uint64)).sum() <= len(sets[i] ^ sets[j])
    made = []
    monkeypatch.setattr(op, "written", lambda df, name, *a, f=op.written: made.append((name, f(df, name, *a))) or made[-1][1])
    docs = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")
    assert sorted(r.doc_id for r in op.dedup(docs).collect() if r.text == "") == list(range(300, 320))
    assert 20 <= {name: df.count() for name, df in made}["op4-rest"] + 20 < 2_000  # of 51,040 pairs


def test_op5_drops_what_other_operators_left_and_bounds_its_memory():
    import public_tokenizers
    from logloom.llm.memory import kept_by_worker
    from logloom.llm.op5_sentencepiece import piece_table
    made = []

    @kept_by_worker
    def index(name):
        made.append(name)
        return [name]

    index("a")
    table = piece_table(public_tokenizers.path("piece_bpe_32k.model"), 10)
    index("a")
    assert made == ["a", "a"]
    words = [f"{x}{y}" for x in "abcdefghij" for y in "klmnopqrst"]
    for word in words:
        assert table.encode(word).tolist() == table.ids_of("▁" + word)
    assert max(len(table.runs), len(table.units.young), len(table.units.old)) <= 12


def test_sentencepiece_stage_lets_executors_collect_first(spark, monkeypatch):
    from logloom.llm import common
    from logloom.llm.op5_sentencepiece import sentencepiece_stage
    asked = []
    monkeypatch.setattr(common, "collected", lambda s, f=common.collected: asked.append(f(s)))
    rows = sentencepiece_stage(spark, spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string"), None).collect()
    assert asked == [2 * spark.sparkContext.defaultParallelism] and {r.doc_id: r.n_tokens == len(r.ids) for r in rows} == {1: True, 2: True}


def test_op4_counts_bands_alone_and_leaves_the_last_join_to_spark(spark, monkeypatch):
    """Of a band that is met once only its number is shuffled; no count of rows decides that texts stay where they are."""
    from logloom.llm import op4_line_dedup as op
    made = {}
    monkeypatch.setattr(op, "written", lambda df, name, *a, f=op.written: made.setdefault(name, df) is None or f(df, name, *a))
    docs = spark.createDataFrame([(i, f"a line that nearly all of these documents repeat, but for {i // 2}\nline {i} of its own") for i in range(20)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = op.dedup(docs)
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.count() == 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert made["op4-bands"].columns == ["band"] and "max(" not in made["op4-bands"]._jdf.queryExecution().optimizedPlan().toString()
