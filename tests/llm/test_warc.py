"""Derived records: read back as a file, links, digests."""

import base64
import hashlib
import html
import random
import re
import time

from pyspark.sql import functions as F

from textwarden.llm import warc as W

PAGE = (
    "<!DOCTYPE html><html lang=\"fr\"><head><title>A &amp; B</title><style>p{x:1}</style><script>var t='</p>';</script>"
    "</head><body><nav><a href='/x'>Home</a></nav><!-- <p>no</p> --><p>One<b>two</b>&eacute;<br>3 &lt; 4</p></body></html>"
)
SCHEMA = "page_id long, url string, html string, key string, type string"


def parsed(data):
    """The records of a file: (headers, block)."""
    out = []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        assert version == "WARC/1.1"
        fields = dict(x.split(": ", 1) for x in lines)
        n = int(fields["Content-Length"])
        assert rest[n : n + 4] == b"\r\n\r\n"
        out.append((fields, rest[:n]))
        data = rest[n + 4 :]
    return out


def sha(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_records_read_back(spark):
    pages = [(1, "http://a.example/ü x", PAGE, "k", "t"), (2, None, None, "", ""), (3, "u", "", "", ""),
             (None, "v", "<p>" * 40_000 + "end", "", ""), (1, "http://a.example/ü x", PAGE, "k", "t")]
    df = spark.createDataFrame(pages, SCHEMA)
    responses = W.responses_of(df, "page_id", "url", "html", "2024-01-01T00:00:00Z")
    records = W.derivatives(responses).withColumn("file", W.as_bytes())
    rows = records.collect()
    assert len(rows) == 2 * len(pages)
    sources = {r["record_id"]: r for r in responses.collect()}
    assert len(sources) == len(pages) - 1  # the repeated page has the same identifier
    for r in rows:
        ((fields, block),) = parsed(bytes(r["file"]))
        of = sources[r["refers_to"]]
        assert fields["WARC-Refers-To"] == of["record_id"] and fields["WARC-Record-ID"] == r["record_id"]
        assert fields["WARC-Type"] == r["type"] and block == bytes(r["block"])
        assert fields.get("WARC-Target-URI") == of["target_uri"] and fields["WARC-Date"] == of["date"]
        assert fields["WARC-Block-Digest"] == r["block_digest"] == sha(block)
        assert fields["WARC-Source-Payload-Digest"] == r["source_digest"] == sha((of["payload"] or "").encode())
    meta = {r["refers_to"]: bytes(r["block"]).decode() for r in rows if r["type"] == "metadata"}
    for r in rows:
        if r["type"] == "conversion":
            assert f"conversion-id: {r['record_id']}\r\n" in meta[r["refers_to"]]
            assert "source-header: HTTP/1.1 200 OK\r\n" in meta[r["refers_to"]]
    by_key = {r["key"]: r for r in rows if r["type"] == "conversion"}
    assert bytes(by_key[1]["block"]).decode() == "A & B\nHome\nOnetwoé\n3 < 4"
    assert bytes(by_key[2]["block"]) == b"" and bytes(by_key[None]["block"]) == b"end"
    assert "title: A & B\r\nlang: fr\r\nlinks: 1\r\n" in meta[by_key[1]["refers_to"]]
    assert W.derivatives(responses.limit(0)).count() == 0


def test_same_identifiers_again(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "", "")], SCHEMA)
    run = lambda: sorted(r["record_id"] for r in W.derivatives(W.responses_of(df, "page_id", "url", "html", "d")).collect())
    assert run() == run()


def test_headers_cannot_be_broken(spark):
    responses = spark.createDataFrame([(1, "<urn:uuid:x>", "http://a\r\nWARC-Type: evil", None, None, "x")],
                                      "key long, record_id string, target_uri string, date string, http_headers string, payload string")
    for r in W.derivatives(responses).withColumn("file", W.as_bytes()).collect():
        ((fields, _),) = parsed(bytes(r["file"]))
        assert fields["WARC-Target-URI"] == "http://a WARC-Type: evil" and "WARC-Date" not in fields


def test_text_of_plain_markup():
    assert W.plain_text("a < b &amp;&amp; c > d") == "a < b && c > d"
    assert W.plain_text(html.escape("<p>x</p>")) == "<p>x</p>"


def by_characters(page):
    """(text, title, links) by a loop over characters, one after the other."""
    low, i, out, title, title_from, links = page.lower(), 0, "", None, None, 0
    while i < len(page):
        if page[i] != "<":
            out += page[i]
            i += 1
            continue
        if page[i : i + 4] == "<!--":
            j = i + 4
            while j < len(page) and page[j : j + 3] != "-->":
                j += 1
            out, i = out + " ", j + 3
            continue
        j = i + 1
        slash = page[j : j + 1] == "/"
        j += slash
        name = ""
        while j < len(page) and low[j].isascii() and (low[j].isalpha() or name and low[j].isdigit()):
            name += low[j]
            j += 1
        k = i
        while k < len(page) and page[k] != ">":
            k += 1
        if k == len(page) or not (name or slash or page[i + 1] in "!?"):
            out += "<"
            i += 1
            continue
        mark, i = page[i : k + 1], k + 1
        if name in W.HIDDEN and not slash:
            out += " "
            while i < len(page) and not re.match(rf"</{name}\s*>", low[i:]):
                i += 1
            i = i + low[i:].find(">") + 1 if i < len(page) else i
        elif name in W.BLOCK:
            out += "\n"
        if name == "title" and title is None:
            if not slash and title_from is None:
                title_from = len(out)
            elif slash and title_from is not None:
                title = out[title_from:]
        links += name == "a" and not slash and bool(re.search(r"\bhref\s*=", mark, re.I))
    tidy = lambda t: "\n".join(y for y in (" ".join(x.split()) for x in html.unescape(t).split("\n")) if y)
    return tidy(out), None if title is None else tidy(title), links


def test_pages_equal_a_character_loop():
    r = random.Random(7)
    bits = ["<p>", "</p>", "<br/>", "<!--", "-->", "<script>", "</script>", "</SCRIPT >", "<style x='>'>", "</style>", "<title>", "</title>",
            "<a href='/x'>", "<a name=y>", "</a>", "<", ">", "< b", "</", "<!doctype html>", "<?x?>", "word ", "&lt;p&gt;", "&amp;", "\n", "é", "<b", "1",
            "<scripty>", "</script", "<Title lang=x>", "<html lang=\"fr\">", "<h1>", "<h7>"]
    for _ in range(3000):
        page = "".join(r.choice(bits) for _ in range(r.randrange(14)))
        got = W.read_page(page)
        assert (got.text, got.title, got.links) == by_characters(page), page


def test_only_ascii_letters_are_lowered():
    # characters whose lower case is longer, or an ASCII letter, and one that has no bytes
    page = "İ\u212aſẞÀ\ud800<SCRIPT>x</ſCRIPT></Script ><TITLE>İA</Title><\u212a>B<P>C"
    assert W.ascii_lower(page) == "".join(x.lower() if x.isascii() else x for x in page)
    got = W.read_page(page)
    assert (got.text, got.title) == ("İ\u212aſẞÀ\ud800\nİA\n<\u212a>B\nC", "İA")


def test_letters_beyond_ascii_cost_little_more():
    def seconds(word):
        page, took = ("<p>" + word * 20) * 3000, []
        for _ in range(3):
            start = time.process_time()
            W.read_page(page)
            took.append(time.process_time() - start)
        return min(took)

    assert seconds("abcdefghij klmnopqrst é ") < 6 * seconds("abcdefghij klmnopqrst e ")


def test_a_megabyte_of_unclosed_marks_takes_no_second():
    for mark in ("<script ", "<script>", "<!--", "<!-- -", "<a ", "<title>", "<", "</", "<p", "<html lang", "</script", "<style></script >", "<template></", "<title></titl"):
        page = mark * (1_000_000 // len(mark))
        start = time.perf_counter()
        W.derive("<urn:uuid:x>", "u", "d", None, page)
        assert time.perf_counter() - start < 2, mark
