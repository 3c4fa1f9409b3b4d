"""WARC derivatives: responses become linked metadata and plain-text conversion records.

Each response gives two records.  Both refer to the response's identifier, keep its
target URI and date, and carry the digest of the payload they were made from; the
conversion's identifier stands in the metadata, so either leads to the other.
Identifiers are name-based, so a second run gives the same ones.  Row work, no shuffle.

Null payloads are empty; a null URI, date or header set is left out.  Repeated rows give
repeated records with the same identifiers.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textwarden.llm.store import by_batch

CRLF = "\r\n"
HIDDEN = ("script", "style", "noscript", "template")
BLOCK = frozenset(
    "p div br li ul ol tr table h1 h2 h3 h4 h5 h6 article section header footer nav title blockquote pre".split()
)
NAME = re.compile(r"(/?)([a-z][a-z0-9]*)?")
LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
HREF = re.compile(r"\bhref\s*=", re.I)
SPACES = re.compile(r"\s+")

RECORDS = (
    "type string, record_id string, refers_to string, target_uri string, date string, content_type string,"
    " content_length long, block_digest string, source_digest string, header string, block binary"
)


def digest(data: bytes) -> str:
    """The labelled digest of the format: SHA-1 in base 32."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def ascii_lower(page: str) -> str:
    """The page with A-Z in lower case and all else as it is, so that every place stays where it was.

    Bytes are lowered just so, and at once; a table of characters is asked for each one of a page
    that is not all ASCII.
    """
    return page.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


class Page(NamedTuple):
    """What a page says: its visible text, its title and language if it has them, and its links."""

    text: str
    title: str | None
    lang: str | None
    links: int


def read_page(page: str) -> Page:
    """One pass over the marks of a page; every search goes on where the last one ended.

    Comments and the elements of HIDDEN count for nothing; where one is never closed, the rest
    of the page belongs to it.  Other marks go, those of blocks leave a line end; one that is
    never closed is text.  References are decoded, blanks squeezed.  The title is that of the
    first title element that is closed, the language that of the first html mark.
    """
    low, out, title, title_at, lang, links = ascii_lower(page), [], None, None, None, 0
    at, last_end = 0, page.rfind(">")
    while True:
        start = page.find("<", at)
        if start < 0:
            break
        out.append(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            out.append(" ")
            at = len(page) if end < 0 else end + 3
            continue
        slash, name = NAME.match(low, start + 1).groups()
        if start > last_end or not (name or slash or page[start + 1 : start + 2] in ("!", "?")):
            out.append("<")  # no mark, or one that is never closed
            at = start + 1
            continue
        end = page.find(">", start)
        mark = page[start : end + 1]
        at = end + 1
        if name in HIDDEN and not slash:
            out.append(" ")
            at = _closed(low, name, at)
        elif name in BLOCK:
            out.append("\n")
        if name == "title" and title is None:
            if not slash:
                title_at = len(out) if title_at is None else title_at
            elif title_at is not None:
                title = _lines("".join(out[title_at:]))
        elif name == "html" and not slash and lang is None:
            found = LANG.search(mark)
            lang = found[1] if found else None
        elif name == "a" and not slash:
            links += bool(HREF.search(mark))
    out.append(page[at:])
    return Page(_lines("".join(out)), title, lang, links)


def _closed(low: str, name: str, at: int) -> int:
    """Where the element of this name ends that is open here: behind its closing mark, or at the end."""
    close = "</" + name
    while (at := low.find(close, at)) >= 0:
        at += len(close)
        end = low.find(">", at)
        if end >= 0 and not low[at:end].strip():
            return end + 1
        if end < 0:
            break
    return len(low)


def _lines(text: str) -> str:
    lines = (" ".join(x.split()) for x in html.unescape(text).split("\n"))
    return "\n".join(x for x in lines if x)


def plain_text(page: str) -> str:
    """Visible text: blocks on lines of their own, references decoded, blanks squeezed."""
    return read_page(page).text


def _header(fields: list[tuple[str, str | None]]) -> str:
    return "WARC/1.1" + CRLF + _fields(fields) + CRLF


def _fields(fields) -> str:
    return "".join(f"{k}: {SPACES.sub(' ', str(v))}{CRLF}" for k, v in fields if v is not None)


def _record(kind, record_id, refers_to, uri, date, content_type, block: bytes, source: str, more=()) -> tuple:
    of_block = digest(block)
    head = _header([
        ("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Refers-To", refers_to), ("WARC-Target-URI", uri),
        ("WARC-Date", date), ("WARC-Block-Digest", of_block), ("WARC-Source-Payload-Digest", source), *more,
        ("Content-Type", content_type), ("Content-Length", len(block)),
    ])
    return kind, record_id, refers_to, uri, date, content_type, len(block), of_block, source, head, block


def derive(record_id: str, uri: str | None, date: str | None, http: str | None, payload: str | None) -> list[tuple]:
    """The metadata and the conversion record of a response."""
    page = payload or ""
    source = digest(page.encode("utf-8", "replace"))
    meta_id, text_id = (
        f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {record_id} {source}')}>" for kind in ("metadata", "conversion")
    )
    said = read_page(page)
    text = said.text
    fields = [
        ("title", said.title), ("lang", said.lang),
        ("links", said.links), ("characters", len(text)), ("conversion-id", text_id),
        *(("source-header", x) for x in (http or "").splitlines() if x),
    ]
    meta = _fields(fields)
    about = (record_id, uri, date)
    return [
        _record("metadata", meta_id, *about, "application/warc-fields", meta.encode("utf-8", "replace"), source),
        _record("conversion", text_id, *about, "text/plain; charset=utf-8",
                text.encode("utf-8", "replace"), source, [("WARC-Concurrent-To", meta_id)]),
    ]


def derivatives(responses: DataFrame) -> DataFrame:
    """Two records per response.

    ``responses``: key, record_id, target_uri, date, http_headers, payload.
    """
    kept = responses.select("key", "record_id", "target_uri", "date", "http_headers", "payload")
    names = [x.strip().split()[0] for x in RECORDS.split(",")]
    types = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in RECORDS.split(",")]

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = [batch.column(i).to_pylist() for i in range(1, 6)]
        rows = [r for values in zip(*columns) for r in derive(*values)]
        twice = pa.array([i for i in range(batch.num_rows) for _ in (0, 1)], pa.int64())
        cols = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
        return pa.RecordBatch.from_arrays([batch.column(0).take(twice), *cols], ["key", *names])

    return by_batch(kept, make, f"key {kept.schema['key'].dataType.simpleString()}, {RECORDS}")


def responses_of(pages: DataFrame, key: str, url: str, page: str, date: str) -> DataFrame:
    """Fetched pages as response records; identifiers from key, address and payload."""
    payload = F.coalesce(F.col(page), F.lit(""))
    h = F.md5(F.concat_ws("\x1f", F.lit("response"), F.col(key).cast("string"), F.col(url), payload).cast("binary"))
    part = lambda a, n: F.substring(h, a, n)
    urn = F.concat(
        F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-8"), part(14, 3), F.lit("-8"), part(18, 3),
        F.lit("-"), part(21, 12), F.lit(">"),
    )
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.octet_length(payload).cast("string"), F.lit(CRLF),
    )
    return pages.select(
        F.col(key).alias("key"), urn.alias("record_id"), F.col(url).alias("target_uri"), F.lit(date).alias("date"),
        http.alias("http_headers"), F.col(page).alias("payload"),
    )


def as_bytes() -> Column:
    """A record as it stands in a file: header, block, two line ends."""
    return F.concat(F.col("header").cast("binary"), F.col("block"), F.lit(CRLF * 2).cast("binary"))
