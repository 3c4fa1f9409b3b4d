"""Secret scan: candidates in every text, judged by the owners and repositories that show them.

A value that stands with many owners, or in many repositories of few, is a copied example
(a key from a manual, a licence header); one that only its owner has, in a few places, and
that looks random, is a live credential.  Occurrences are counted, but decide nothing: a
page repeated a thousand times still shows its key in one repository.  The scan is row work; the judgement counts narrow rows
(value hash, owner, repository), summed before every shuffle, so that a value copied
into a third of all rows arrives as a handful of counts.

Null texts are empty, null owners and repositories are one owner and one repository of
their own; repeated rows give repeated results and count once per owner.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from textwarden.llm.store import by_batch, stored

#: A private key from its first line to its last, or, where the last is missing, to the end of
#: its base64 lines; these may be indented, quoted, joined by escapes or stand in one line.
#: Every run is possessive and stops at five dashes, so that many first lines stay linear.
_EDGE = r"[A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
_GAP = r"(?:\\+[nrt]|[\s\"'\\+,>#*|])"
_FIELD = r"[A-Za-z][A-Za-z0-9-]*+:[ \t]*+[^\s\\\"']++"
_LAST = r"[ \t\"'+,]*+(?:\r?\n|\\+n)" + _GAP + r"*+[A-Za-z0-9+/]++(?:={1,2}|(?=[ \t]*+(?:[\"'\\\r\n]|\Z)))"
PEM = (
    rf"-----BEGIN {_EDGE}"
    rf"([^-]*+(?:-(?!----)[^-]*+)*+(?=-----END {_EDGE})"
    rf"|(?:{_GAP}*+{_FIELD})*+(?:{_GAP}*+[A-Za-z0-9+/]{{16,}}+={{0,2}})++(?:{_LAST}|{_GAP}++[A-Za-z0-9+/]++={{1,2}})?+)"
    rf"(?:-----END {_EDGE})?+"
)
_NOT_KEY = re.compile(rf"{_FIELD}|[\"']\s*\+\s*[\"']|\\+[nrt]|[^A-Za-z0-9+/=]")

#: Patterns of the base kinds are fixed values, in the order in which ties are listed.
#: Only ASCII letters have two cases.
KINDS = {
    "assign": (
        r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        re.I | re.A,
        2,
        6,
    ),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 0, 24),
    # kinds beyond the base
    "pem": (PEM, 0, 1, 20),
    # from the first character of a token on: "eyJ" may stand in it many times
    "jwt": (r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+", 0, 0, 20),
    "login": (r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]++:([^\s/:@]{6,}+)@", 0, 1, 6),
}
BASE = ("assign", "access", "hex")
#: A text that none of these fits has no candidate; they are searched by automaton, without backtracking.
HINTS = {
    "assign": r"(?i)(?:password|passwd|secret|token|api_?key)[\"']? *[:=]",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
    "pem": r"PRIVATE KEY(?: BLOCK)?-----",
    "jwt": r"eyJ[A-Za-z0-9_-]{10,}\.eyJ",
    "login": r"://[^\s/:@]+:[^\s/:@]{6,}@",
}
PLACEHOLDER = re.compile(r"example|sample|dummy|test|changeme|placeholder|your|xxxx", re.I)
COPIED_OWNERS = 3  # owners from which on a value is a copied example
COPIED_REPOS = 4  # repositories, of all owners together, from which on it is one too
SALTS = 16  # parts into which the rows of one set of values are dealt
MARK = "[REDACTED]"  # stands for a live credential
LIVE_BITS = 2.5  # bits per character from which on a value looks random

SCANNED = (
    "n_assign long, n_access long, n_hex long, base_sha256 string, spans string,"
    " found array<struct<kind:string,start:long,end:long,hash:string,live:boolean>>, found_key string"
)


def looks_live(value: str) -> bool:
    """Random-looking, and no placeholder word in it."""
    counts = Counter(value).values()
    bits = -sum(n / len(value) * math.log2(n / len(value)) for n in counts)
    return bits >= LIVE_BITS and not PLACEHOLDER.search(value)


def key_body(value: str) -> str:
    """The base64 text of a private key, the same however its lines are set."""
    return _NOT_KEY.sub("", value)


def key_looks_live(body: str) -> bool:
    """As for other values; a placeholder word may stand in a long key by chance."""
    rest = PLACEHOLDER.sub("", body)
    return len(rest) >= KINDS["pem"][3] and looks_live(rest)


def compiled() -> dict:
    return {k: (re.compile(p, f), g, least) for k, (p, f, g, least) in KINDS.items()}


def digest(value: str) -> str:
    return hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest()[:32]


def candidates(texts: pa.Array) -> list[int]:
    """Positions of the texts in which a kind may occur."""
    hits = [pc.fill_null(pc.match_substring_regex(texts, hint), False) for hint in HINTS.values()]
    return pc.indices_nonzero(reduce(pc.or_, hits)).to_pylist()


def find(text: str, kinds: dict) -> list[tuple[int, int, str, int, str]]:
    """(start, order of the kind, kind, end, value) of all spans of a text, sorted."""
    out = []
    for order, (kind, (pattern, group, least)) in enumerate(kinds.items()):
        for m in pattern.finditer(text):
            value = key_body(m.group(group)) if kind == "pem" else m.group(group)
            if len(value) >= least:
                out.append((m.start(), order, kind, m.end(), value))
    return sorted(out)


def scan(docs: DataFrame, text: str, keep: dict[str, str]) -> DataFrame:
    """Columns ``keep`` (new name: column) and those of SCANNED, one row per row."""
    kept = docs.select(*[F.col(c).alias(n) for n, c in keep.items()])
    n_keep, empty = len(keep), hashlib.sha256(b"").hexdigest()
    # the text is sent to the workers once, if it is kept as well
    at_text = next((i for i, c in enumerate(keep.values()) if c == text), n_keep)
    if at_text == n_keep:
        kept = docs.select(*[F.col(c).alias(n) for n, c in keep.items()], F.col(text).alias("__text"))

    def row(t: str, kinds: dict) -> tuple:
        spans = find(t, kinds)
        said = [(f"{k}:{a}:{b}", k) for a, _, k, b, _ in spans]
        base = ",".join(s for s, k in said if k in BASE)
        n = Counter(k for _, k in said)
        live = lambda k, v: key_looks_live(v) if k == "pem" else looks_live(v)
        found = [{"kind": k, "start": a, "end": b, "hash": digest(v), "live": live(k, v)} for a, _, k, b, v in spans]
        key = hashlib.sha256("".join(f["hash"] for f in found).encode()).hexdigest() if found else None
        every = ",".join(s for s, _ in said)
        return (*(n[k] for k in BASE), hashlib.sha256(base.encode()).hexdigest(), every, found, key)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, kinds = batch.column(at_text), compiled()
        rows = [(0, 0, 0, empty, "", [], None)] * batch.num_rows
        for i in candidates(texts):
            rows[i] = row(texts[i].as_py(), kinds)
        cols = list(zip(*rows))
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                          ("hash", pa.string()), ("live", pa.bool_())])
        types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.list_(span), pa.string()]
        out = [*batch.columns[:n_keep], *(pa.array(c, t) for c, t in zip(cols, types))]
        names = [*batch.schema.names[:n_keep], *"n_assign n_access n_hex base_sha256 spans found found_key".split()]
        return pa.RecordBatch.from_arrays(out, names)

    return by_batch(kept, make, StructType([*kept.schema.fields[:n_keep], *StructType.fromDDL(SCANNED).fields]))


def value_owners(found: DataFrame) -> DataFrame:
    """Per value hash: distinct owners, distinct repositories, occurrences and its class.

    ``found``: hash, live, owner, repo, one row per occurrence.
    """
    per_repo = found.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"), F.max("live").alias("live"))
    per_owner = per_repo.groupBy("hash", "owner").agg(
        F.count("*").alias("repos"), F.sum("n").alias("n"), F.max("live").alias("live")
    )
    per_value = per_owner.groupBy("hash").agg(
        F.count("*").alias("n_owners"),
        F.sum("repos").alias("n_repos"),
        F.sum("n").alias("n_found"),
        F.max("live").alias("live"),
    )
    spread = (F.col("n_owners") >= COPIED_OWNERS) | (F.col("n_repos") >= COPIED_REPOS)
    kind = F.when(spread, "copied").when(F.col("live"), "live").otherwise("weak")
    return per_value.withColumn("class", kind)


def judged(scanned: DataFrame) -> DataFrame:
    """Adds ``classes``, ``owners``, ``repos`` and ``times``, one entry per span in the order of ``found``.

    A class is copied, live or weak; the others are the distinct owners and repositories of
    the span's value and its occurrences.

    ``scanned`` has found, found_key, owner and repo.  Classes come back by the digest of a
    row's values, so that rows need no unique id and copies are judged once.
    """
    spans = scanned.filter("found_key IS NOT NULL").select("owner", "repo", "found_key", F.explode("found").alias("f"))
    spans = spans.select("owner", "repo", "found_key", "f.hash", "f.live")
    said = F.struct("class", "n_owners", "n_repos", "n_found")
    values = value_owners(spans).select("hash", said.alias("said"))
    per_key = (
        spans.select("found_key", "hash")
        .distinct()
        .join(values, "hash")
        .groupBy("found_key")
        .agg(F.map_from_entries(F.collect_list(F.struct("hash", "said"))).alias("__said"))
    )
    # rows without a span get a key of their own, or they would all meet in one task
    alone = F.concat(F.lit("-"), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)).cast("string"))
    rows = scanned.withColumn("found_key", F.coalesce("found_key", alone))
    # the same values may stand in a third of all rows
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    per_key = per_key.withColumn("__salt", salts())
    of = {"classes": "class", "owners": "n_owners", "repos": "n_repos", "times": "n_found"}
    each = F.transform("found", lambda f: F.element_at("__said", f["hash"]))
    judged_ = rows.join(per_key, ["found_key", "__salt"], "left").drop("__salt")
    return judged_.withColumns({c: each[n] for c, n in of.items()})


def salts() -> Column:
    """Every salt: the small side of a join, once for each part of the other."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))


def secret_scan(docs: DataFrame, key: str, text: str, owner: str, repo: str) -> DataFrame:
    """One row per row of ``docs``: counts, spans and what the corpus says about each span.

    Columns: doc_id, n_assign, n_access, n_hex, base_sha256, spans, found, classes,
    owners, repos, times.
    """
    # repeated names are allowed: owner and repo may be the same column
    scanned = stored(scan(docs, text, {"doc_id": key, "owner": owner, "repo": repo}), "secrets")
    return judged(scanned).drop("owner", "repo", "found_key", "__said")


def redact(docs: DataFrame, key: str, text: str, owner: str, repo: str, mark: str = MARK) -> DataFrame:
    """The rows of ``docs`` with every live span, and what overlaps it, replaced by a mark.

    Copied examples and weak values stay.  Every text is scanned once, and stored with what was
    found in it.  Only texts with a find are shuffled, to meet the live values among theirs; the
    others pass straight through.
    """
    found = F.transform("found", lambda f: F.struct(f["start"], f["end"], f["hash"], f["live"]))
    columns = {f"__{i}": c for i, c in enumerate(docs.columns)}
    at_owner, at_repo, at_text = (list(columns)[docs.columns.index(c)] for c in (owner, repo, text))
    scanned = scan(docs, text, columns).select(*columns, F.when(F.size("found") > 0, found).alias("__found"))
    scanned = stored(scanned, "secrets-found")
    spans = scanned.select(F.col(at_owner).alias("owner"), F.col(at_repo).alias("repo"), F.explode("__found").alias("f"))
    live = value_owners(spans.select("owner", "repo", "f.hash", "f.live")).filter("class = 'live'")
    out = _without(scanned, at_text, live.select(F.col("hash").alias("__hash")), mark)
    return out.select(*[F.col(n).alias(c) for n, c in columns.items()])


def _without(scanned: DataFrame, text: str, live: DataFrame, mark: str) -> DataFrame:
    """The columns of ``scanned`` but __found, with the live spans of a text replaced."""
    names = [c for c in scanned.columns if c != "__found"]
    plain = scanned.filter("__found IS NULL").select(*names)
    hashes = F.array_sort(F.array_distinct(F.transform("__found", lambda f: f["hash"])))
    rows = scanned.filter("__found IS NOT NULL").withColumn("__hashes", hashes)
    rows = rows.withColumn("__key", F.sha2(F.concat_ws(",", "__hashes"), 256))
    per_key = (
        rows.select("__key", F.explode("__hashes").alias("__hash"))
        .distinct()
        .join(live, "__hash")
        .groupBy("__key")
        .agg(F.collect_list("__hash").alias("__live"))
    )
    # a value may stand in a third of all rows: these are dealt over several tasks
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64(text), F.lit(SALTS)))
    rows = rows.join(per_key.withColumn("__salt", salts()), ["__key", "__salt"], "left").select(*names, "__found", "__live")
    at, schema = names.index(text), StructType([scanned.schema[n] for n in names])

    def without(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, found, gone = (batch.column(i).to_pylist() for i in (at, len(names), len(names) + 1))
        out = [replaced(t, f, set(g), mark) if g else t for t, f, g in zip(texts, found, gone)]
        cols = list(batch.columns[: len(names)])
        cols[at] = pa.array(out, batch.schema.field(at).type)
        return pa.RecordBatch.from_arrays(cols, names)

    return plain.unionByName(by_batch(rows, without, schema))


def replaced(t: str, found: list[dict], live: set[str], mark: str) -> str:
    """The text with its live spans replaced; overlapping spans become one mark."""
    out, at = [], 0
    for f in found:
        if f["hash"] in live:
            if f["start"] >= at:
                out += [t[at : f["start"]], mark]
            at = max(at, f["end"])
    return "".join([*out, t[at:]])
