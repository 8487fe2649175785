import gzip
import os
import zlib

import duckdb
from pyspark.sql import functions as F

from modlens.llm import sql, warc
from modlens.llm.base import scratch


def run(spark, pages, file_bytes=1 << 20):
    records = warc.with_record_types(pages, 1000, "page_id", "url", "html")
    plain = warc.write_monolithic(records, scratch(spark, "warc-plain"), file_bytes)
    plain = spark.createDataFrame(plain.collect(), warc.FILES)
    archives = spark.createDataFrame(warc.normalise(plain, scratch(spark, "warc")).collect(), warc.FILES)
    return plain, archives, warc.read_records(archives)


ROWS = [
    (1, "http://a/1", "x" * 2000), (2, "http://a/2", "x" * 2000), (3, None, "x" * 2000), (4, "http://a/\r\nEvil: 1", None),
    (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (9, "é ü", "naïve " * 300), (9, "again", "naïve " * 300),
    (11, "crlf", "a\r\n\r\nWARC/1.1\r\n\r\n" * 80), (12, "long", "y" * 3_000_000), (None, "z", "x" * 2000), (None, "q", "only" * 400),
    (-5, "neg", "naïve " * 300),
]


def test_round_trip_and_types(spark):
    d = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    plain, archives, back = run(spark, d)
    got = back.collect()
    assert len(got) == len(ROWS) and all(r.intact for r in got)
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", [r for r in ROWS if r[0] is not None])
    want = sorted(con.execute(sql.WARC).fetchall(), key=str)
    assert want == sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got if r.page_id is not None), key=str)
    nulls = {(r.payload_bytes, r.record_type, r.refers_to) for r in got if r.page_id is None}
    assert nulls == {(2000, "revisit", 3), (1600, "response", None)}


def test_archives_have_a_member_per_record_and_an_index(spark):
    d = spark.createDataFrame(ROWS[:9], "page_id long, url string, html string").coalesce(1)
    plain, archives, _ = run(spark, d)
    for p, a in zip(plain.collect(), archives.collect()):
        with open(p.path.removeprefix("file:"), "rb") as f:
            raw = f.read()
        engine = zlib.decompressobj(wbits=31)
        whole = engine.decompress(raw)
        assert engine.eof and not engine.unused_data                     # one stream before
        with open(a.path.removeprefix("file:"), "rb") as f:
            new = f.read()
        assert gzip.decompress(new) == whole                             # the same bytes after
        at = 0
        import json

        with open(a.index_path.removeprefix("file:")) as f:
            entries = [json.loads(x) for x in f]
        for e in entries:
            assert e["offset"] == at
            headers, _ = warc.parse_record(zlib.decompress(new[at:at + e["length"]], wbits=31))
            assert headers["warc-record-id"] == e["id"] and headers["warc-type"] == e["type"]
            at += e["length"]
        assert at == len(new) == a.bytes and len(entries) == a.records


def test_damaged_archives_keep_their_whole_records(spark, tmp_path):
    good = b"".join(warc.record(i, "u", b"p" * 3000, "00" * 20, None) for i in range(5))
    cases = {"cut.gz": gzip.compress(good)[:-40], "junk.gz": gzip.compress(good + b"no record\r\n\r\n"), "short.gz": gzip.compress(good[:-100]),
             "two.gz": gzip.compress(good[:5000]) + gzip.compress(good[5000:]), "empty.gz": b"", "not.gz": b"plain"}
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
    files = spark.createDataFrame([(str(tmp_path / n),) for n in cases], "path string")
    got = dict(zip(cases, warc.normalise(files.coalesce(1), str(tmp_path / "out")).collect()))
    assert got["two.gz"].records == 5 and got["two.gz"].error is None
    assert got["empty.gz"].records == 0 and got["empty.gz"].error is None
    assert got["short.gz"].records == 4 and got["junk.gz"].records == 5 and got["not.gz"].records == 0
    assert all(got[n].error for n in ("cut.gz", "junk.gz", "short.gz", "not.gz"))
    assert os.path.exists(got["two.gz"].index_path)


def test_empty(spark):
    d = spark.createDataFrame([], "page_id long, url string, html string")
    records = warc.with_record_types(d, 1000, "page_id", "url", "html")
    assert warc.write_monolithic(records, scratch(spark, "w")).collect() == []
