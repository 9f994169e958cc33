"""ARC and WARC files: exact round trips, hand-made archives, damaged ones, and the query against brute force."""

import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from docengine.llm import archives
from docengine.llm.queries import QUERIES


def brute(pages):
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of distinct page ids."""
    best = {}
    for i, _, html in pages:
        x = (html or "").encode()
        if len(x) >= 1000:
            best[x] = max(best.get(x, i), i)
    out = []
    for i, _, html in pages:
        x = (html or "").encode()
        again = best.get(x, i) != i
        out.append((i, len(x), hashlib.sha1(x).hexdigest(), "revisit" if again else "response", best[x] if again else None))
    return sorted(out, key=str)


def pages():
    r = random.Random(2)
    bits = ["\n", "\r\n", "\r\n\r\n", "\r", "WARC/1.1\r\n", "filedesc://x 0.0.0.0 20000101000000 text/plain 3\n", "é🎉", "<p>text</p>", "\x00", "HTTP/1.1 200 OK\r\n\r\n", "Content-Length: 7\r\n", "http://a 0.0.0.0 20000101000000 text/html 5\nabcde\n"]
    html = lambda n: "".join(r.choices(bits, k=n))
    out = [(i, f"http://h{i}.org/a b\n{i}é", html(r.randrange(40))) for i in range(1, 120)]
    same, short = "x\r\n" * 400, "y" * 999
    out += [(200 + i, f"http://same{i}", same) for i in range(60)] + [(300 + i, None, short) for i in range(5)]
    out += [(400, "", None), (401, "http://e", ""), (402, "u", "z" * 1000), (403, "u", "z" * 1000), (-5, "n", "\r\n" * 3), (404, "long", "ab\n" * 400000)]
    return out


def test_query_same_as_brute_force(spark, tmp_path):
    rows = pages()
    d = str(tmp_path)
    spark.createDataFrame([(*x, "clash") for x in rows], "page_id long, url string, html string, block string").repartition(3).write.parquet(f"{d}/pages.parquet")
    got = QUERIES["op12_archives"](spark, d)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_nulls_repeats_and_empty_tables(spark, tmp_path):
    rows = [(None, "a", "q" * 2000), (None, "a", "q" * 2000), (1, "b", "r" * 2000), (1, "b", "r" * 2000), (2, "c", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/some/pages.parquet")
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in QUERIES["op12_archives"](spark, f"{tmp_path}/some").collect()), key=str)
    assert got == sorted([(None, "response", None), (None, "revisit", None), (1, "response", None), (1, "revisit", 1), (2, "response", None)], key=str)
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/none/pages.parquet")
    assert QUERIES["op12_archives"](spark, f"{tmp_path}/none").count() == 0


def test_beyond_the_broadcast(spark, tmp_path):
    rows = pages()[100:]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    archives.write_arc(archives.page_records(df), f"{tmp_path}/arc", 2)
    for most in (0, 1000):
        archives.to_warc(spark, f"{tmp_path}/arc", f"{tmp_path}/warc{most}", archives._page_id(), most_broadcast=most)
    read = [sorted(map(tuple, archives.read_warc(spark, f"{tmp_path}/warc{m}").drop("archive", "start").collect()), key=str) for m in (0, 1000)]
    assert read[0] == read[1] and not any(r[-2] for r in read[0])  # digests of blocks and payloads fit




def arc(version, *records):
    fields = archives.ARC_FIELDS[version].encode() + b"\n"
    about = b"%d 0 Archive\n" % version + fields
    more = b" 200 - - 0 x.arc" if version == 2 else b""
    return b"filedesc://x.arc 0.0.0.0 19960923142103 text/plain" + more + b" %d\n" % len(about) + about + b"\n" + b"".join(records)


ONE = b"http://a.org/x y 1.2.3.4 19970102030405 text/html 30\nHTTP/1.0 200 OK\r\n\r\nbody\n\nbody2\n"
DNS = b"dns:a.org 1.2.3.4 1998 text/dns 9\n1.2.3.4\r\n\n"
TWO = b"http://b.org/ 1.2.3.4 199701020304 text/html; charset=x 404 - - 55 f.arc 26\nHTTP/1.0 404 No\nA: b\n\n\xff\xfe!\n\n"
WANT = {
    "one": [("http://a.org/x y", "1997-01-02T03:04:05Z", b"body\n\nbody2", "response")],
    "dns": [("dns:a.org", "1998-01-01T00:00:00Z", b"1.2.3.4\r\n", "resource")],
    "two": [("http://b.org/", "1997-01-02T03:04:00Z", b"\xff\xfe!\n", "response")],
}


@pytest.mark.parametrize("pack", ["plain", "gz", "members"])
def test_hand_made_archives(spark, tmp_path, pack):
    d = tmp_path / "arc"
    d.mkdir()
    files = {"one": arc(1, ONE, DNS), "two": arc(2, TWO), "none": b"", "bare": arc(1)}
    for name, data in files.items():
        cut = data.find(b"http://b") if name == "two" else len(data) // 2
        packed = {"plain": data, "gz": gzip.compress(data), "members": gzip.compress(data[:cut]) + gzip.compress(data[cut:])}[pack]
        (d / f"{name}.arc{'' if pack == 'plain' else '.gz'}").write_bytes(packed)
    bad = archives.to_warc(spark, str(d), f"{tmp_path}/warc")
    assert bad.count() == 0
    rows = archives.read_warc(spark, f"{tmp_path}/warc").collect()
    assert sorted(r.type for r in rows) == ["resource", "response", "response", "warcinfo", "warcinfo", "warcinfo"]
    got = sorted((r.url, r.date, bytes(r.payload), r.type) for r in rows if r.type != "warcinfo")
    assert got == sorted(x for v in WANT.values() for x in v)
    assert all(r.problem is None and r.payload_digest == hashlib.sha1(bytes(r.payload)).hexdigest() for r in rows)
    assert len({r.record_id for r in rows}) == 6 and all(r.record_id.startswith("<urn:uuid:") for r in rows)


@pytest.mark.parametrize("pack", ["plain", "gz"])
def test_damaged_archives(spark, tmp_path, pack):
    whole = arc(1, ONE, ONE)
    files = {"cut": whole[:-3], "end": whole[:-1], "length": whole.replace(b"html 30", b"html 25", 1), "header": whole.replace(b" 19970102030405", b"", 1), "v3": whole.replace(b"1 0 Arch", b"3 0 Arch"), "two": arc(2, ONE), "text": b"no archive\n"}
    for name, data in files.items():
        (tmp_path / f"{name}{'' if pack == 'plain' else '.gz'}").write_bytes(data if pack == "plain" else gzip.compress(data))
    rows = archives.read_arc(spark, str(tmp_path)).collect()
    said = {n: [r.problem for r in sorted(rows, key=lambda r: r.start) if r.archive.split(".")[0] == n] for n in files}
    assert said == {"cut": [None, None, "truncated"], "end": [None] * 3, "length": [None, "length"], "header": [None, "header"], "v3": ["version"], "two": [None, "header"], "text": ["header"]}
    archives.to_warc(spark, str(tmp_path), f"{tmp_path}-warc")
    assert archives.read_warc(spark, f"{tmp_path}-warc").filter("problem is not null").count() == 0


def test_urls_and_dates(spark):
    df = spark.createDataFrame([(None, "1997"), ("", "199701"), ("a b\té", "19970102030405"), ("http://x/?%20", "20010203040506789")], "u string, date string")
    got = [tuple(r) for r in df.select(archives.safe_url(F.col("u")), archives.iso_date(F.col("date"))).collect()]
    assert got == [("urn:none", "1997-01-01T00:00:00Z"), ("urn:none", "1997-01-01T00:00:00Z"), ("a%20b%09%C3%A9", "1997-01-02T03:04:05Z"), ("http://x/?%20", "2001-02-03T04:05:06Z")]
