"""Derivative records: links, digests and texts, and a round trip through written files."""

import base64
import glob
import hashlib
import json

from pyspark.sql import types as T

from quotelake.llm.queries import QUERIES
from quotelake.llm.warc import derive, page_responses, read_http, read_warc, split_records, unzip, write_warc

SF = "/root/testdata/sf0.001"
PAGE = T.StructType([T.StructField(c, t) for c, t in (
    ("page_id", T.LongType()), ("url", T.StringType()), ("html", T.StringType()), ("id", T.StringType()), ("headers", T.StringType()))])
ODD = [
    (1, "http://a.example/", "<html><title>T &amp; u</title><body><a href='/x'>go</a><p>one  two\n<p>drei ü</body>"),
    (2, None, "plain"), (3, "http://b.example/", None), (4, "http://c.example/", ""), (None, "http://d.example/", "<p>x</p>"),
    (5, "http://e.example/", "WARC/1.0 in the text\r\n\r\nand more" * 3), (6, "http://f.example/", "<p>long text</p>" * 30_000),
    (6, "http://f.example/", "<p>long text</p>" * 30_000), (7, "http://g.example/", "<script>x</script><!-- c -->"),
]


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def check(records, pages):
    """Every page has one record of each kind, linked to one response, with the right digests."""
    assert len(records) == 2 * len(pages)
    html = {}
    for i, url, body in pages:
        html[(i, url)] = (body or "").encode()
    for r in records:
        block, body = bytes(r["block"]), html[(r["id"], r["target_uri"])]
        source = dict(r["source_headers"])
        assert r["refers_to"] == source["WARC-Record-ID"] != r["record_id"] and source["WARC-Type"] == "response"
        assert r["payload_digest"] == sha1(body) == source["WARC-Payload-Digest"]
        assert r["block_digest"] == sha1(block) and r["content_length"] == len(block)
        if r["warc_type"] == "metadata":
            told = json.loads(block)["Envelope"]
            assert told["WARC-Header-Metadata"] == source
            http = told["Payload-Metadata"]["HTTP-Response-Metadata"]
            assert http["Entity-Length"] == len(body) and http["Headers"]["Content-Length"] == str(len(body))
    assert len({(r["refers_to"], r["warc_type"]) for r in records}) == len({r["record_id"] for r in records})


def test_odd_pages_and_written_files(spark, tmp_path):
    df = spark.createDataFrame([(*r, "x", "y") for r in ODD], PAGE)
    made = derive(page_responses(df))
    records = made.collect()
    check(records, ODD)
    text = {r["id"]: bytes(r["block"]).decode() for r in records if r["warc_type"] == "conversion"}
    assert text[1] == "T & u\ngo\none two\ndrei ü" and text[2] == "plain" and text[3] == text[4] == text[7] == ""
    assert text[6].count("long text") == 30_000
    told = next(json.loads(bytes(r["block"])) for r in records if r["id"] == 1 and r["warc_type"] == "metadata")
    page = told["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]["HTML-Metadata"]
    assert page == {"Title": "T & u", "Links": [{"path": "a@link", "url": "/x"}]}

    write_warc(made, f"{tmp_path}/out")
    back = [x for f in sorted(glob.glob(f"{tmp_path}/out/*.gz")) for x in split_records(unzip(open(f, "rb").read()))]
    assert sorted((h["WARC-Record-ID"], h["WARC-Refers-To"], b) for h, b in back) == sorted(
        (r["record_id"], r["refers_to"], bytes(r["block"])) for r in records)


def test_given_pages(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    check(derive(page_responses(spark.read.parquet(f"{SF}/pages.parquet"))).collect(), pages)
    assert QUERIES["op10_warc"](spark, SF).count() == 2 * len(pages)


def test_responses_read_from_files(spark, tmp_path):
    import gzip

    rows = page_responses(spark.createDataFrame([(*r, "x", "y") for r in ODD], PAGE)).collect()
    record = lambda r: b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in r["headers"].items()).encode() + b"\r\n" + bytes(r["http"]) + b"\r\n\r\n"
    with open(f"{tmp_path}/a.warc.gz", "wb") as f:
        for r in rows:
            f.write(gzip.compress(record(r)))
    got = derive(read_warc(spark, str(tmp_path))).collect()
    want = derive(page_responses(spark.createDataFrame([(*r, "x", "y") for r in ODD], PAGE))).collect()
    key = lambda r: (r["record_id"], bytes(r["block"]))
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_http_and_empty(spark):
    assert read_http(b"no http") == ("", {}, b"no http")
    assert read_http(b"HTTP/1.1 200 OK\r\nA: b: c\r\n\r\nbody\r\n\r\n") == ("HTTP/1.1 200 OK", {"A": "b: c"}, b"body\r\n\r\n")
    assert derive(page_responses(spark.createDataFrame([], PAGE))).collect() == []


def test_text_and_links_after_icons(spark):
    html = "<p>one<svg class='i'/><p><a href='/x'>two</a><object><object></object>no</object><math/><p>three"
    made = derive(page_responses(spark.createDataFrame([(1, "http://a.example/", html, "x", "y")], PAGE))).collect()
    block = {r["warc_type"]: bytes(r["block"]).decode() for r in made}
    assert block["conversion"] == "one\ntwo\nthree"
    told = json.loads(block["metadata"])["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]["HTML-Metadata"]
    assert told["Links"] == [{"path": "a@link", "url": "/x"}]
