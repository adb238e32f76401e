"""Metadata and plain-text conversion records from WARC responses.

Every response gives two records that refer to it (``WARC-Refers-To``, target URI and date): a *metadata* record whose block
is canonical JSON (source WARC and HTTP headers, title, language, links, payload digest, length), and a *conversion* record
whose block is the text of the page. Both carry their own record id, derived from the source id and the record type, and a
SHA-1 digest of their block in base 32. ids are stable: running again gives the same records.

The text keeps words: scripts, styles, comments and tags go, block elements end a line, character references are
decoded, runs of blanks become one. A null body counts as empty (both records exist, with empty text); null headers are empty;
a null record id gives null references. Repeated responses give repeated records. Extra columns are ignored.
"""
from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_UNSEEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(r"</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|article|section|nav|header|footer|title|head|body|html|main|aside|pre|blockquote|form|dl|dd|dt|hr)\b[^>]*>", re.I)
_TAG = re.compile(r"<[!/?a-zA-Z][^>]*>")
_BLANKS = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([\w-]+)", re.I)
_LINK = re.compile(r"<(a|link|img)\b[^>]*?\b(?:href|src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", re.I)

_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace of RFC 4122


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def plain_text(body: str) -> str:
    """Visible text of a page, one line per block element."""
    text = _TAG.sub("", _BREAK.sub("\n", _UNSEEN.sub(" ", _TITLE.sub("", body, count=1))))
    text = html.unescape(text) if "&" in text else text
    return _LINES.sub("\n", _BLANKS.sub(" ", text)).strip(" \n")


def page_facts(body: str) -> dict:
    title, lang = _TITLE.search(body), _LANG.search(body)
    seen = _UNSEEN.sub(" ", body)
    return {"title": " ".join(html.unescape(title[1]).split()) if title else None, "lang": lang[1] if lang else None,
            "links": [{"tag": m[1].lower(), "url": html.unescape(m[2] if m[2] is not None else m[3])} for m in _LINK.finditer(seen)]}


def fields(headers: str | None) -> list[list[str]]:
    """Header lines as [name, value], in order, with repeats; the status line is ["", line]."""
    out = []
    for line in (headers or "").split("\r\n"):
        name, colon, value = line.partition(":")
        if line:
            out.append([name.strip(), value.strip()] if colon and " " not in name else ["", line])
    return out


def derived(row: dict) -> Iterator[dict]:
    """The metadata and the conversion record of one response."""
    body, source = row["body"] or "", row["record_id"]
    payload = digest(body.encode())
    facts = page_facts(body) | {"http": fields(row["http_headers"]), "warc": fields(row["warc_headers"]), "payload_digest": payload, "payload_length": len(body.encode())}
    blocks = (("metadata", "application/json", json.dumps(facts, ensure_ascii=False, sort_keys=True, separators=(",", ":"))), ("conversion", "text/plain; charset=utf-8", plain_text(body)))
    for kind, content, block in blocks:
        raw = block.encode("utf-8", "replace")
        own = None if source is None else f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{source} {kind}')}>"
        head = {"WARC-Type": kind, "WARC-Record-ID": own, "WARC-Refers-To": source, "WARC-Refers-To-Target-URI": row["target_uri"], "WARC-Refers-To-Date": row["warc_date"],
                "WARC-Target-URI": row["target_uri"], "WARC-Date": row["warc_date"], "WARC-Block-Digest": digest(raw), "Content-Type": content, "Content-Length": str(len(raw))}
        yield {"record_id": own, "warc_type": kind, "refers_to": source, "target_uri": row["target_uri"], "warc_date": row["warc_date"], "content_type": content,
               "content_length": len(raw), "block_digest": head["WARC-Block-Digest"], "source_digest": payload,
               "headers": "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None) + "\r\n", "block": block}


def record_bytes(row) -> bytes:
    """A record as it stands in a WARC file."""
    return row["headers"].encode() + row["block"].encode() + b"\r\n\r\n"


_SCHEMA = ("record_id string, warc_type string, refers_to string, target_uri string, warc_date string, content_type string, content_length long, "
           "block_digest string, source_digest string, headers string, block string")
_TYPES = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in _SCHEMA.split(", ")])


def _derived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            rows = batch.slice(at, 200).to_pylist()
            yield pa.RecordBatch.from_pylist([d for row in rows for d in derived(row)], _TYPES)


def derivatives(responses: DataFrame) -> DataFrame:
    """Two records per response (record_id, target_uri, warc_date, warc_headers, http_headers, body)."""
    columns = ("record_id", "target_uri", "warc_date", "warc_headers", "http_headers", "body")
    return responses.select(*[F.col(c).cast("string").alias(c) for c in columns]).mapInArrow(_derived, _SCHEMA)


def responses_of(pages: DataFrame) -> DataFrame:
    """``pages`` as the response records of a crawl: page k was fetched k seconds into 2024."""
    md5 = F.md5(F.concat_ws(" ", F.col("page_id").cast("string"), F.coalesce("url", F.lit(""))).cast("binary"))
    name = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(md5, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))
    date = F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    length = F.octet_length(F.coalesce("html", F.lit(""))).cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length, F.lit("\r\n"))
    warc = F.concat(F.lit("WARC-Type: response\r\nWARC-Record-ID: "), name, F.lit("\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")), F.lit("\r\nWARC-Date: "), date, F.lit("\r\n"))
    return pages.select("page_id", name.alias("record_id"), F.col("url").alias("target_uri"), date.alias("warc_date"), warc.alias("warc_headers"), http.alias("http_headers"), F.col("html").alias("body"))
