"""WARC archives: round trips, the index against a plain filter, and the SQL."""
import base64
import gzip
import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, html string, surt string, file string, offset long, page long, sha string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 3, 4, "z") for r in rows], SCHEMA).repartition(4)


def some():
    rng = random.Random(8)
    hosts = ["example.com", "www.example.com", "a.b.example.org", "EXAMPLE.com:8080", "deep.news.example.net"]
    rows = [(i, f"http://{rng.choice(hosts)}/{rng.randrange(40)}?q={i % 7}", f"<p>page {i % 60} é</p>" * (i % 5)) for i in range(400)]
    rows += [(1000 + i, "http://hot.example.com/", "<p>hot</p>") for i in range(300)]  # one URL and payload in many rows
    rows += [(2000, None, None), (2001, "", ""), (2002, "no url at all", "x\r\n\r\ny"), (2003, "http://[bad/", "WARC/1.1\r\n"), (2004, "http://a.com/with space\nand line", "\x00  ")]
    rows += [(None, "http://example.com/none", "<p>hot</p>"), (None, "http://example.com/none", "<p>only null keys</p>"), (None, None, "<p>only null keys</p>")]
    rows += [(2100, "http://long.example.com/", "long text " * 200_000)] + [rows[3]] * 2  # a long text, repeated rows
    return rows


def brute(rows):
    top = {}
    for k, _, h in rows:
        h = h or ""
        top[h] = k if top.get(h) is None else top[h] if k is None else max(top[h], k)
    out = []
    for k, _, h in rows:
        h = h or ""
        again = top[h] is not None and k != top[h]
        out.append((k, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "revisit" if again else "response", top[h] if again else None))
    return sorted(out, key=str)


@pytest.fixture
def small_blocks(monkeypatch):
    from logloom.llm import op11_warc as op
    monkeypatch.setattr(op, "LINES", 7)
    monkeypatch.setattr(op, "FILE_BYTES", 4000)
    return op


def test_query_equals_brute_force_and_sql(spark, tmp_path):
    from logloom.llm.op11_warc import ORACLE_SQL, op11_warc
    frame(spark, some()).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((tuple(r) for r in op11_warc(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(some())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert sorted(con.execute(ORACLE_SQL).fetchall(), key=str) == got


def test_lookup_finds_all_captures(spark, tmp_path, small_blocks):
    op, rows = small_blocks, some()
    captures = op.write_archive(frame(spark, rows), str(tmp_path / "a"))
    assert captures.select("file").distinct().count() > 4
    index = op.write_index(captures, str(tmp_path / "a"))
    assert index.agg(F.sum("lines")).first()[0] == len(rows) and index.agg(F.sum("blocks")).first()[0] > len(rows) / 7
    wanted = ["http://hot.example.com/", "https://www.example.com/3?q=1", "http://nowhere.example/", "zzz", "", None]
    found = op.read_records(op.lookup(spark.createDataFrame([(w,) for w in wanted * 2], "url string"), index)).collect()
    keys = {op.url_key(w) for w in wanted}
    want = [(k, h or "") for k, u, h in rows if op.url_key(u) in keys]
    bodies = {r.payload_digest: r.payload for r in op.read_records(captures).collect() if r.record_type == "response"}
    assert sorted(((r.page_id, bodies[r.payload_digest].decode()) for r in found), key=str) == sorted(want, key=str)
    assert op.lookup(spark.createDataFrame([], "url string"), index).count() == 0


def test_files_are_warc(spark, tmp_path):
    from logloom.llm.op11_warc import write_archive
    captures = write_archive(frame(spark, some()[:50]), str(tmp_path / "a"), least=20)
    rows = captures.collect()
    assert all(r.record_type == "response" for r in rows if r.digest == base64.b32encode(hashlib.sha1(b"").digest()).decode())  # below 20 bytes
    for path in {r.file for r in rows}:
        data = open(path, "rb").read()
        whole = gzip.decompress(data)  # records are gzip members that follow each other
        mine = sorted((r.offset, r.length) for r in rows if r.file == path)
        assert whole.count(b"WARC/1.1\r\nWARC-Type: ") == len(mine)
        assert [o for o, _ in mine] == [sum(n for _, n in mine[:i]) for i in range(len(mine))] and sum(n for _, n in mine) == len(data)


def test_empty(spark, tmp_path):
    from logloom.llm.op11_warc import op11_warc
    frame(spark, []).write.parquet(str(tmp_path / "pages.parquet"))
    assert op11_warc(spark, str(tmp_path)).count() == 0


def test_keys():
    from logloom.llm.op11_warc import url_key
    assert url_key("https://www.Example.com:443/a?b=1#c") == "com,example)/a?b=1" == url_key("http://user@example.com/a?b=1")
    assert url_key("http://example.com:8080") == "com,example:8080)/" and url_key(None) == "-" and " " not in url_key("a b\tc")


def test_damage_is_found():
    from logloom.llm.op11_warc import digest_of, parsed, record
    good = record(5, "http://a.com/", b"text", digest_of(hashlib.sha1(b"text").digest()), None, False)
    assert parsed(good)["payload"] == b"text"
    with pytest.raises(ValueError):
        parsed(record(5, "http://a.com/", b"texts", digest_of(hashlib.sha1(b"text").digest()), None, False))
