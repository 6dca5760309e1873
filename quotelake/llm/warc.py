"""WARC derivatives: linked metadata and plain-text conversion records of response records.

`derive` takes response records (their WARC headers as a map and the HTTP message as bytes) and gives two records of
each: `metadata`, a JSON block with the source's WARC and HTTP headers, title and links, and `conversion`, the visible
text as plain text. Both name the response in WARC-Refers-To, keep its target address and date, carry the source's
payload digest and a digest of their own block. Record ids are made from the response id and the record type, so a task
that runs again writes the same ids. Responses come from WARC files (`read_warc`) or from a table of pages
(`page_responses`); `write_warc` writes records as WARC files through Spark's own text writer. All steps are narrow.

Defined cases: null or empty html is an empty payload, with an empty text and no links; a null address is left out of
the headers; bytes that are no UTF-8 are replaced; a response without an HTTP part keeps empty headers; repeated rows
give repeated records with equal ids; an empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelake.llm.htmlblocks import read_page

#: Date of responses whose source names none.
DATE = "2024-01-01T00:00:00Z"
#: Responses derived at a time in a task.
RECORDS_AT_ONCE = 128
RESPONSES = "id long, headers map<string,string>, http binary"
RECORDS = (
    "id long, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, "
    "payload_digest string, block_digest string, content_type string, content_length long, source_headers map<string,string>, block binary"
)
_CHARSET = re.compile(r"charset=[\"']?([\w.:-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(parts))}>"


def _map(items: dict[str, str]) -> list[tuple[str, str]]:
    return list(items.items())


def page_responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """(id, headers, http): one response record for every page."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("html"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            headers, messages = [], []
            for page, url, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
                head = {"WARC-Type": "response", "WARC-Record-ID": record_id("response", str(page), str(url), digest(body))}
                if url is not None:
                    head["WARC-Target-URI"] = url
                head |= {"WARC-Date": date, "WARC-Payload-Digest": digest(body), "WARC-Block-Digest": digest(http),
                         "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(http))}
                headers.append(_map(head))
                messages.append(http)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(headers, pa.map_(pa.string(), pa.string())), pa.array(messages, pa.binary())],
                names=["id", "headers", "http"])

    return rows.mapInArrow(run, RESPONSES)


def read_http(message: bytes) -> tuple[str, dict[str, str], bytes]:
    """Status line, headers (the last of a name counts) and payload."""
    head, gap, body = message.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    if not gap or not lines[0].startswith("HTTP/"):
        return "", {}, message
    return lines[0], {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}, body


def derivatives(headers: dict[str, str], message: bytes) -> list[tuple]:
    """The metadata and the conversion record of one response, in the order of the record columns after the id."""
    status, http, body = read_http(message)
    charset = _CHARSET.search(next((v for k, v in http.items() if k.lower() == "content-type"), ""))
    try:
        html = body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        html = body.decode("utf-8", "replace")
    page = read_page(html)
    source = headers.get("WARC-Record-ID", "")
    payload = headers.get("WARC-Payload-Digest") or digest(body)
    described = {
        "Envelope": {
            "WARC-Header-Metadata": headers,
            "Payload-Metadata": {
                "HTTP-Response-Metadata": {
                    "Response-Message": status, "Headers": http, "Entity-Length": len(body), "Entity-Digest": payload,
                    "HTML-Metadata": {"Title": page.title, "Links": [{"path": f"{tag}@link", "url": url} for tag, url in page.links]},
                },
            },
        },
    }
    blocks = {
        "metadata": ("application/json", json.dumps(described, ensure_ascii=False, sort_keys=True).encode("utf-8", "replace")),
        "conversion": ("text/plain", "\n".join(b.text for b in page.blocks).encode("utf-8", "replace")),
    }
    uri, date, kept = headers.get("WARC-Target-URI"), headers.get("WARC-Date"), _map(headers)
    return [
        (kind, record_id(kind, source), source, uri, date, payload, digest(block), mime, len(block), kept, block)
        for kind, (mime, block) in blocks.items()
    ]


def derive(responses: DataFrame) -> DataFrame:
    """Two derivative records of every response (id, headers, http)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, RECORDS_AT_ONCE):
                part = batch.slice(at, RECORDS_AT_ONCE)
                rows = [
                    (page, *record)
                    for page, headers, message in zip(*(c.to_pylist() for c in part.columns), strict=True)
                    for record in derivatives(dict(headers or []), message or b"")
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    return responses.select("id", "headers", "http").mapInArrow(run, RECORDS)


_TEXT = pa.string()
_SCHEMA = pa.schema([
    ("id", pa.int64()), ("warc_type", _TEXT), ("record_id", _TEXT), ("refers_to", _TEXT), ("target_uri", _TEXT), ("warc_date", _TEXT),
    ("payload_digest", _TEXT), ("block_digest", _TEXT), ("content_type", _TEXT), ("content_length", pa.int64()),
    ("source_headers", pa.map_(_TEXT, _TEXT)), ("block", pa.binary()),
])


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Derivative records as WARC files, one for each partition; a record is its headers, a blank line and its block."""
    header = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(c).cast("string"), F.lit("\r\n")))
    names = {
        "WARC-Type": "warc_type", "WARC-Record-ID": "record_id", "WARC-Refers-To": "refers_to", "WARC-Target-URI": "target_uri",
        "WARC-Date": "warc_date", "WARC-Payload-Digest": "payload_digest", "WARC-Block-Digest": "block_digest",
        "Content-Type": "content_type", "Content-Length": "content_length",
    }
    text = F.concat_ws("", F.lit("WARC/1.1\r\n"), *(header(k, c) for k, c in names.items()), F.lit("\r\n"), F.col("block").cast("string"))
    records.select(text.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def split_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of a plain WARC file."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(next(v for k, v in headers.items() if k.lower() == "content-length"))
        yield headers, data[end + 4:end + 4 + size]
        at = end + 4 + size


def unzip(data: bytes) -> bytes:
    """A gzip file of any number of members; other data as they are."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        data = member.unused_data
    return b"".join(out) if out else data


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Response records of WARC files (plain or gzip, a file in a task) as `derive` takes them; id is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for headers, block in split_records(unzip(content.as_py())):
                    if headers.get("WARC-Type") == "response":
                        yield pa.RecordBatch.from_arrays([
                            pa.array([None], pa.int64()), pa.array([_map(headers)], pa.map_(pa.string(), pa.string())),
                            pa.array([block], pa.binary()),
                        ], names=["id", "headers", "http"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RESPONSES)
