import gzip
import hashlib
import html
import random
import re
import zlib

import duckdb
import pytest

from willowfold.llm import warc

HTML = "<!DOCTYPE html><html LANG='fr'><head><meta charset=\"UTF-8\"><title>A &amp; <b>B</b>\n</title><style>p{}</style></head><body><!-- <p>no</p> --><script>var t='</p>';</script><p>One&nbsp;two &lt;3&gt;</p>\n<p>x</p></body></html>"


def test_text_and_links(spark):
    pages = spark.createDataFrame([(1, "http://a/x", HTML, "z"), (2, None, None, "z"), (None, "http://b", "", "z"), (1, "http://a/x", HTML, "z")], "page_id long, url string, html string, record_id string")
    source = warc.responses(pages)
    got = warc.derive(source).collect()
    assert len(got) == 8
    own = {r.warc_type: r for r in got if r.page_id == 1}
    ids = {r.record_id for r in source.collect()}
    assert own["conversion"].block == "One two <3> x"
    assert own["metadata"].block.split("\r\n")[:3] == ["title: A & B", "charset: utf-8", "language: fr"]
    for r in got:
        assert r.refers_to in ids and r.record_id not in ids
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest()
        assert r.content_length == len(r.block.encode()) and r.source_headers.startswith("HTTP/1.1 200 OK")
    assert own["conversion"].source_digest == "sha256:" + hashlib.sha256(HTML.encode()).hexdigest()
    assert [r.block for r in got if r.page_id == 2 and r.warc_type == "conversion"] == [""]
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


def test_files_read_back(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    records = warc.derive(warc.responses(pages))
    warc.write(records, str(tmp_path / "warc"))
    got = {r.headers["WARC-Record-ID"]: (r.headers, bytes(r.block).decode()) for r in warc.read(spark, str(tmp_path / "warc/part-*")).collect()}
    want = records.collect()
    assert len(got) == len(want) == 2 * pages.count()
    for r in want:
        headers, block = got[r.record_id]
        assert block == r.block and headers["WARC-Refers-To"] == r.refers_to and headers["WARC-Type"] == r.warc_type
        assert headers["WARC-Block-Digest"] == r.block_digest and headers["WARC-Source-Digest"] == r.source_digest
        own = r.source_headers.split("\r\n")
        assert headers["WARC-Source-HTTP-Status"] == own[0] == "HTTP/1.1 200 OK"
        assert all(headers["WARC-Source-HTTP-" + line.split(": ")[0]] == line.split(": ")[1] for line in own[1:])
        if r.warc_type == "metadata":
            assert block.split("\r\n")[5:] == ["source-status: HTTP/1.1 200 OK", *("source-" + line for line in own[1:]), ""]


def test_gzip_and_foreign_responses(spark, tmp_path):
    def record(kind, number, block):
        head = f"WARC/1.{number % 2}\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{number}>\r\nWARC-Target-URI: http://a/{number}\r\nWARC-Date: 2020-01-0{number}T00:00:00Z\r\nContent-Length: {len(block)}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    http = b"HTTP/1.1 404 Not Found\r\nServer: x: y\r\nContent-Type: text/html\r\n\r\n"
    inner = b"<p>a record\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc</p>"
    records = [record("warcinfo", 1, b"\xff\xfe"), record("response", 2, http + inner), record("response", 3, http + "<p>é</p>".encode()), record("response", 4, b"HTTP/1.1 204 No Content")]
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain/a.warc").write_bytes(b"".join(records))
    (tmp_path / "gz").mkdir()
    (tmp_path / "gz/a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))  # a member for each record
    for path in ("plain", "gz"):
        rows = warc.read(spark, str(tmp_path / path))
        assert sorted(bytes(r.block) for r in rows.collect()) == sorted([b"\xff\xfe", http + inner, http + "<p>é</p>".encode(), b"HTTP/1.1 204 No Content"])  # records come in no order
        got = {(r.refers_to, r.warc_type): r for r in warc.derive(warc.responses_of(rows)).collect()}
        assert len(got) == 6
        assert got["<urn:uuid:3>", "conversion"].block == "é" and got["<urn:uuid:3>", "conversion"].date == "2020-01-03T00:00:00Z"
        assert got["<urn:uuid:2>", "conversion"].block == "a record WARC/1.0 WARC-Type: response Content-Length: 3 abc"
        assert "source-status: HTTP/1.1 404 Not Found\r\nsource-Server: x: y\r\n" in got["<urn:uuid:2>", "metadata"].block
        assert got["<urn:uuid:4>", "metadata"].source_headers == "HTTP/1.1 204 No Content" and got["<urn:uuid:4>", "conversion"].block == ""
    warc.write(warc.derive(warc.responses_of(rows)), str(tmp_path / "out"), "gzip")
    assert warc.read(spark, str(tmp_path / "out/part-*")).count() == 6


def test_all_entities_are_decoded_once(spark):
    raw = "&copy; 2026 &middot; caf&eacute; &#8217;&#xE9; &amp;lt; &amp;eacute; &nbsp;&#160;x &notanentity; &copy2 &#0; &#xD800; a & b &NotEqualTilde; \xa0|"
    page = f"<html><head><title>Caf&eacute; &amp;copy; &#8212;</title></head><body><p>{raw}</p></body></html>"
    pages = spark.createDataFrame([(1, "http://a", page)], "page_id long, url string, html string")
    got = {r.warc_type: r.block for r in warc.derive(warc.responses(pages)).collect()}
    plain = html.unescape(re.sub("&nbsp;|&#160;", " ", raw))
    assert got["conversion"] == re.sub("[\x20\x09-\x0d]+", " ", plain).strip(" ")
    assert got["metadata"].split("\r\n")[0] == "title: Café &copy; —"
    given = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = {r.page_id: r.html for r in given.collect()}
    for r in warc.derive(warc.responses(given)).where("warc_type = 'conversion'").collect():
        text = html.unescape(re.sub(warc.REMOVED, " ", rows[r.page_id]).replace("&nbsp;", " "))
        assert r.block == re.sub("[\x20\x09-\x0d]+", " ", text).strip(" ") and "©" in r.block


def test_sql_decodes_as_the_operator():
    bits = ["&copy;", "&copy", "&notit;", "&not", "&#65;", "&#x41;", "&#0;", "&#128;", "&#xD800;", "&#x110000;", "&#99999999999999999999;", "&#xFDD0;", "&nbsp;", "&#160;", "&amp;lt;", "&", "&;", "&x;", "&eacute", "&NotEqualTilde;", "&#x;", "a", " ", "\n", "é", "&amp", "lt;", "'", "\xa0"]
    rng = random.Random(1)
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(500)]
    con = duckdb.connect()
    con.execute("create table t as select unnest(?) as x", [texts])
    got = con.execute(f"with {warc._SQL_NAMES} select x, {warc._sql_decoded('x')} from t, names").fetchall()
    assert len(got) == 500 and all(d == warc.decoded(t) for t, d in got)


def _raw(number, block, kind="response", length=None, head=None):
    head = head or f"WARC-Type: {kind}\r\nWARC-Record-ID: <urn:{number}>\r\nContent-Length: {len(block) if length is None else length}"
    return f"WARC/1.1\r\n{head}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _files(folder, files, packed):
    folder.mkdir()
    for name, data in files.items():
        (folder / (name + ".warc" + ".gz" * packed)).write_bytes(gzip.compress(data) if packed else data)
    return str(folder)


@pytest.mark.parametrize("packed", [False, True])
def test_a_torn_record_is_reported_and_takes_nothing(spark, tmp_path, packed):
    files = {f"g{i:02}": b"".join(_raw(f"{i}-{j}", b"block %d" % j) for j in range(1 + 2 * (i % 2))) for i in range(31)}
    files["a"] = _raw("torn", b"four", length=60)[:-4]
    files["m"] = _raw("m1", b"one") + _raw("m2", b"two", length=50) + _raw("m3", b"three") + _raw("m4", b"a longer one", length=3)
    files["j"] = b"no record\r\n" + b"\r\n\r\n" + _raw("j", b"x")
    rows = warc.read(spark, _files(tmp_path / "in", files, packed)).collect()
    good = {r.headers["WARC-Record-ID"]: bytes(r.block) for r in rows if not r.fault}
    want = {f"<urn:{i}-{j}>": b"block %d" % j for i in range(31) for j in range(1 + 2 * (i % 2))}
    assert good == want | {"<urn:m1>": b"one", "<urn:m3>": b"three", "<urn:j>": b"x"}
    bad = {r.headers.get("WARC-Record-ID", ""): (bytes(r.block), r.fault) for r in rows if r.fault}
    assert bad["<urn:torn>"] == (b"four", "cut short") and bad["<urn:m2>"] == (b"two", "cut short") and bad["<urn:m4>"] == (b"a l", "longer than its length")
    assert [f for _, f in bad.values()].count("no WARC record") == 1 and all("/" in r.path for r in rows)
    assert warc.responses_of(warc.read(spark, str(tmp_path / "in"))).count() == len(good)


def test_inner_records_at_every_split(spark, tmp_path):
    inner = _raw("inner", b"inside") + _raw("inner2", b"")
    records = [_raw(1, b"plain"), _raw(2, b"x" + inner + inner + b"y"), _raw(3, inner[:-4]), _raw(4, b""), _raw(5, b"\r\n\r\nWARC/1." * 5), _raw(6, b"end")]
    want = {"<urn:1>": b"plain", "<urn:2>": b"x" + inner + inner + b"y", "<urn:3>": inner[:-4], "<urn:4>": b"", "<urn:5>": b"\r\n\r\nWARC/1." * 5, "<urn:6>": b"end"}
    path = _files(tmp_path / "in", {"a": b"".join(records), "b": records[1]}, False)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (31, 64, 100, 177, 256, 400, 1000, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = warc.read(spark, path).collect()
            assert sorted((r.path[-6:], r.headers["WARC-Record-ID"], bytes(r.block)) for r in rows) == sorted([*(("a.warc", i, b) for i, b in want.items()), ("b.warc", "<urn:2>", want["<urn:2>"])]), size
            assert not any(r.fault for r in rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r.headers["WARC-Record-ID"]: bytes(r.block) for r in warc.read(spark, _files(tmp_path / "gz", {"a": b"".join(records)}, True)).collect()} == want


def test_legal_heads(spark, tmp_path):
    heads = [
        "WARC-Type:response\r\nWARC-Record-ID:<urn:1>\r\nContent-Length:5", "warc-type: response\r\nwarc-record-id: <urn:2>\r\ncontent-length: 5",
        "WARC-Type: response\r\nWARC-Record-ID: <urn:3>\r\nWARC-Target-URI: http://a/\r\n\tb\r\nContent-Length  :\t5 ", "WARC-Type: response\r\nWARC-Record-ID: <urn:4>\r\nWARC-Concurrent-To: <x>\r\nwarc-concurrent-to: <y>\r\nX-Own: é\r\nContent-Length: 5",
    ]
    for packed in (False, True):
        path = _files(tmp_path / f"in{packed}", {"a": b"".join(_raw(0, b"HTTP/", head=h) for h in heads)}, packed)
        rows = {r.headers["WARC-Record-ID"]: r for r in warc.read(spark, path).collect()}
        assert set(rows) == {f"<urn:{i}>" for i in range(1, 5)} and not any(r.fault for r in rows.values())
        assert rows["<urn:3>"].headers["WARC-Target-URI"] == "http://a/ b" and rows["<urn:4>"].headers["WARC-Concurrent-To"] == "<x>, <y>" and rows["<urn:4>"].headers["X-Own"] == "é"
        assert warc.responses_of(warc.read(spark, path)).count() == 4


def test_charsets(spark, tmp_path):
    def page(text, codec, header="", meta=""):
        return f"HTTP/1.1 200 OK\r\nContent-Type: text/html{header}\r\n\r\n".encode() + f"<html><head>{meta}</head><body>{text}</body></html>".encode(codec)

    pages = [
        (page("café €", "cp1252", "; charset=ISO-8859-1"), "café €"), (page("日本語", "cp932", '; Charset="Shift_JIS"'), "日本語"), (page("Привет", "koi8-r", meta="<meta charset='koi8-r'>"), "Привет"),
        (page("ñ", "latin-1", meta="<meta http-equiv=Content-Type content='text/html; charset=latin1'>"), "ñ"), (page("été", "utf-8"), "été"), (page("été", "utf-8", "; charset=no-such"), "été"), (page("été", "utf-8", "; charset=hex"), "été"),
        (page("x", "utf-8").replace(b"<html>", b"\xef\xbb\xbf<html>"), "x"), (b"HTTP/1.1 200 OK\r\n\r\n" + "﻿<p>ö</p>".encode("utf-16-le"), "ö"), (page("a", "utf-8").replace(b">a<", b">\xff<"), "�"),
    ]
    path = _files(tmp_path / "in", {"a": b"".join(_raw(i, block) for i, (block, _) in enumerate(pages))}, False)
    source = warc.responses_of(warc.read(spark, path))
    got = {(r.refers_to, r.warc_type): r for r in warc.derive(source).collect()}
    for i, (block, text) in enumerate(pages):
        payload = block.split(b"\r\n\r\n", 1)[1]
        own = got[f"<urn:{i}>", "conversion"]
        assert own.block == text and own.source_digest == "sha256:" + hashlib.sha256(payload).hexdigest()
        assert f"html-bytes: {len(payload)}\r\n" in got[f"<urn:{i}>", "metadata"].block


def test_nothing_to_read(spark, tmp_path):
    path = _files(tmp_path / "in", {"a": b""}, False)
    assert warc.read(spark, path).count() == 0 and warc.derive(warc.responses_of(warc.read(spark, path))).count() == 0
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.derive(warc.responses(empty)).count() == 0


def test_coded_bodies():
    body = "<p>é one</p>".encode() * 40
    raw = zlib.compressobj(wbits=-15)
    deflated = raw.compress(body) + raw.flush()
    chunked = b"".join(b"%x;x=y\r\n%s\r\n" % (len(c), c) for c in (body[:7], body[7:100], body[100:])) + b"0\r\n\r\n"
    squeezed = gzip.compress(body)
    both = b"%X\r\n%s\r\n0\r\n\r\n" % (len(squeezed), squeezed)
    cases = [("", body), ("Transfer-Encoding: chunked", chunked), ("content-encoding:gzip", squeezed), ("Content-Encoding: deflate", zlib.compress(body)), ("Content-Encoding: deflate", deflated), ("Transfer-Encoding: chunked\r\nContent-Encoding: gzip", both), ("Content-Encoding: gzip", body), ("Content-Encoding: br", body), ("Transfer-Encoding: chunked", body)]
    for header, payload in cases:
        headers, text, size, digest = warc.http_parts(f"HTTP/1.1 200 OK\r\n{header}\r\n\r\n".encode().replace(b"OK\r\n\r\n\r\n", b"OK\r\n\r\n") + payload)
        assert text == body.decode() and size == len(payload) and digest == hashlib.sha256(payload).hexdigest(), header
