"""WARC derivative builder: response records -> linked metadata and plain-text conversion records.

``responses`` turns pages into WARC/1.1 response records; ``derive`` gives for every response a
``metadata`` and a ``conversion`` record that refer to it (WARC-Refers-To), carry its source
headers (target URI, date, record id) and its payload digest. ``write_warc`` writes records as
.warc files through Spark's text writer (a record, then CRLF CRLF); ``read_warc`` reads them back
by Content-Length.

Defined results: a null url is written as an empty target URI and null HTML as an empty payload,
and both still give their records; repeated rows give records with ids of their own (numbered
among equal rows); an empty table gives no records; extra columns are not read. Record ids are
name-based: reruns agree.
"""

from __future__ import annotations

import base64
import hashlib
import html as html_lib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Names of the WARC/1.1 format.
RECORD = ("page_id long, record_type string, record_id string, refers_to string, target_uri string, "
          "warc_date string, content_type string, block_digest string, payload_digest string, "
          "content_length long, headers string, block string")
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
DATE = "2024-01-01T00:00:00Z"

_HIDDEN = re.compile(r"<!--.*?-->|<(script|style|noscript|template|head)\b.*?</\1\s*>|<!doctype[^>]*>", re.I | re.S)
_BLOCKS = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|blockquote|pre|hr|title)\b[^>]*>", re.I)
_TAG = re.compile(r"<[^>]+>")
_GAPS = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.I | re.S)
_LANG = re.compile(r"<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_HREF = re.compile(r"<a\b[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, name)}>"


def plain_text(source: str) -> str:
    """Visible text of HTML: hidden elements and tags go, block elements end lines, entities decode."""
    text = _TAG.sub("", _BLOCKS.sub("\n", _HIDDEN.sub(" ", source.replace("\r", " ").replace("\n", " "))))
    return _LINES.sub("\n", _GAPS.sub(" ", html_lib.unescape(text))).strip()


def _headers(kind: str, rid: str, uri: str, date: str, ctype: str, block: bytes, extra: list[tuple[str, str]]) -> str:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", date), ("WARC-Target-URI", re.sub(r"[\r\n]", " ", uri)),
             *extra, ("WARC-Block-Digest", digest(block)), ("Content-Type", ctype), ("Content-Length", str(len(block)))]
    return "\r\n".join(["WARC/1.1", *(f"{k}: {v}" for k, v in lines)])


def responses(pages: DataFrame, date: str = DATE, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One response record per page row: an HTTP 200 message with the HTML as payload."""
    rows = pages.select(F.col(page_id).cast("long").cast("string").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    rows = rows.withColumn("_h", F.xxhash64("url", "html"))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("page_id", "_h").orderBy(F.lit(0)))).drop("_h")

    # by Spark's own functions: a task then holds one Python worker, that of ``derive``
    rows = rows.select("page_id", "_n", F.coalesce("url", F.lit("")).alias("uri"), F.coalesce("html", F.lit("")).alias("body"))
    rows = rows.withColumn("msg", F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                                           F.octet_length("body").cast("string"), F.lit("\r\n\r\n"), "body"))
    rows = rows.withColumns({"payload": _digest("body"), "digest": _digest("msg"), "length": F.octet_length("msg").cast("long")})
    rows = rows.withColumn("rid", _record_id(F.concat(F.lit("response:"), F.coalesce("page_id", F.lit("None")), F.lit(":"), "uri", F.lit(":"),
                                                      "payload", F.lit(":"), F.col("_n").cast("string"))))
    ctype = "application/http; msgtype=response"
    lines = [("WARC-Type", F.lit("response")), ("WARC-Record-ID", F.col("rid")), ("WARC-Date", F.lit(date)),
             ("WARC-Target-URI", F.translate("uri", "\r\n", "  ")), ("WARC-Payload-Digest", F.col("payload")),
             ("WARC-Block-Digest", F.col("digest")), ("Content-Type", F.lit(ctype)), ("Content-Length", F.col("length").cast("string"))]
    head = F.concat_ws("\r\n", F.lit("WARC/1.1"), *(F.concat(F.lit(f"{k}: "), v) for k, v in lines))
    return rows.select(F.col("page_id").cast("long").alias("page_id"), F.lit("response").alias("record_type"), F.col("rid").alias("record_id"),
                       F.lit(None).cast("string").alias("refers_to"), F.col("uri").alias("target_uri"), F.lit(date).alias("warc_date"),
                       F.lit(ctype).alias("content_type"), F.col("digest").alias("block_digest"), F.col("payload").alias("payload_digest"),
                       F.col("length").alias("content_length"), head.alias("headers"), F.col("msg").alias("block"))


def _digest(text: str) -> Column:
    """``digest`` of a text column: five bytes of the SHA-1 are eight letters of base 32."""
    sha = F.sha1(text)
    parts = [F.lpad(F.conv(F.substring(sha, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.concat(F.lit("sha1:"), F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"))


def _record_id(name: Column) -> Column:
    """``record_id`` of a text column: a UUID of version 5 is the SHA-1 of the name space and the name."""
    sha = F.sha1(F.concat(F.lit(SPACE.bytes), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(sha, 17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat(F.lit("<urn:uuid:"), F.substring(sha, 1, 8), F.lit("-"), F.substring(sha, 9, 4), F.lit("-5"), F.substring(sha, 14, 3),
                    F.lit("-"), variant, F.substring(sha, 18, 3), F.lit("-"), F.substring(sha, 21, 12), F.lit(">"))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    f = pd.DataFrame(rows, columns=[c.split()[0] for c in RECORD.split(", ")])
    return f.astype({"content_length": "int64"})


def derive(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of the response records; others are passed over."""
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a part of a batch at a time: its records go out before the next part's are made
        for b in (whole[at:at + 500] for whole in batches for at in range(0, len(whole), 500)):
            out = []
            for r in b.itertuples(index=False):
                http, _, body = r.block.partition("\r\n\r\n")
                text = plain_text(body)
                conv, meta = record_id(f"conversion:{r.record_id}"), record_id(f"metadata:{r.record_id}")
                source = [("WARC-Refers-To", r.record_id), ("WARC-Refers-To-Target-URI", re.sub(r"[\r\n]", " ", r.target_uri)),
                          ("WARC-Refers-To-Date", r.warc_date)]
                title, lang = _TITLE.search(body), _LANG.search(body)
                fields = [("source-record", r.record_id), ("source-payload-digest", r.payload_digest),
                          ("source-block-digest", r.block_digest), ("conversion-record", conv),
                          *((f"http-{k.strip().lower()}", v.strip()) for k, _, v in (x.partition(":") for x in http.split("\r\n")[1:])),
                          ("title", " ".join(html_lib.unescape(_TAG.sub("", title[1])).split()) if title else ""),
                          ("language", lang[1].lower() if lang else ""), ("links", str(len(_HREF.findall(body)))),
                          ("text-length", str(len(text)))]
                block = "".join(f"{k}: {v}\r\n" for k, v in fields)
                for kind, rid, ctype, data, extra in (
                        ("metadata", meta, "application/warc-fields", block, [*source, ("WARC-Concurrent-To", conv)]),
                        ("conversion", conv, "text/plain; charset=utf-8", text, source)):
                    raw = data.encode()
                    head = _headers(kind, rid, r.target_uri, r.warc_date, ctype, raw, [*extra, ("WARC-Payload-Digest", digest(raw))])
                    out.append((r.page_id, kind, rid, r.record_id, r.target_uri, r.warc_date, ctype, digest(raw), digest(raw), len(raw), head, data))
            yield _frame(out)

    # page ids travel as text: pandas would make floats of the ids beside a null one
    read = records.where("record_type = 'response'").select(F.col("page_id").cast("string").alias("page_id"), "record_id", "target_uri", "warc_date",
                                                            "block_digest", "payload_digest", "block")
    in_python = RECORD.replace("page_id long", "page_id string")
    return read.mapInPandas(make, in_python).withColumn("page_id", F.col("page_id").cast("long"))


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Records as WARC files: headers, an empty line, the block; CRLF CRLF ends a record."""
    (records.select(F.concat("headers", F.lit("\r\n\r\n"), "block").alias("value"))
     .write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(headers, block) of all records in uncompressed or gzip files below ``path``. A file is one
    task's work; Spark's writer decides how large files get."""
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import gzip
        for b in batches:
            for raw in b["content"]:
                raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                at, out = 0, []
                while at < len(raw):
                    end = raw.index(b"\r\n\r\n", at)
                    head = raw[at:end].decode()
                    n = int(re.search(r"(?im)^content-length: *(\d+)", head)[1])
                    out.append((head, raw[end + 4:end + 4 + n].decode()))
                    at = end + 4 + n + 4
                yield pd.DataFrame(out, columns=["headers", "block"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInPandas(parse, "headers string, block string")


def op10_query(pages: DataFrame) -> DataFrame:
    """Every derived record of every page: ids, links, digests and the whole block."""
    return derive(responses(pages)).select("page_id", "record_type", "record_id", "refers_to", "target_uri", "content_type",
                                           "block_digest", "payload_digest", "content_length", "headers", "block")
