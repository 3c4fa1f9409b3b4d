"""Run the registered queries against their SQL twins and report differences.

Usage: python tools/check.py [sf folder] [name or prefix ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
import pyarrow as pa

sys.path.insert(0, __file__.rsplit("/", 2)[0])

from catalog import load_all  # noqa: E402
from textwarden.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(t: pa.Table):
    """Rows as a sorted list of tuples, columns in name order."""
    names = sorted(t.column_names)
    cols = [t.column(n).to_pylist() for n in names]
    rows = list(zip(*cols)) if cols else []
    key = lambda r: tuple((v is None, str(v)) for v in r)
    return names, sorted(rows, key=key)


def differences(got: pa.Table, want: pa.Table) -> list[str]:
    """What differs between two results: columns, types, row counts, values."""
    notes = []
    gn, gr = plain(got)
    wn, wr = plain(want)
    if gn != wn:
        return [f"columns {gn} vs {wn}"]
    types = lambda t: {n: str(t.schema.field(n).type).replace("large_", "") for n in gn}
    a, b = types(got), types(want)
    off = {n: (a[n], b[n]) for n in gn if a[n] != b[n]}
    if off:
        notes.append(f"types {off}")
    if len(gr) != len(wr):
        notes.append(f"rows {len(gr)} vs {len(wr)}")
    if gr != wr:
        diff = [(g, w) for g, w in zip(gr, wr) if g != w]
        notes.append(f"{len(diff)} rows differ, first: {str(diff[:1])[:700]}")
    return notes


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    """A DuckDB connection with the tables of a folder as views."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    queries, oracles = load_all()
    spark = local_session(8)
    con = connect(sf)
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            got = fn(spark, sf).toArrow()
        except Exception as e:
            bad += 1
            print(f"FAIL {name}: spark: {str(e)[:600]}", flush=True)
            continue
        took = time.time() - start
        if name not in oracles:
            print(f"rows {name}: {got.num_rows} rows, {took:.1f}s", flush=True)
            continue
        start = time.time()
        try:
            want = con.execute(oracles[name]).to_arrow_table()
        except Exception as e:
            bad += 1
            print(f"FAIL {name}: sql: {str(e)[:600]}", flush=True)
            continue
        sql_took = time.time() - start
        notes = differences(got, want)
        bad += bool(notes)
        print(
            f"{'FAIL' if notes else 'ok  '} {name}: {got.num_rows} rows, {took:.1f}s, sql {sql_took:.1f}s "
            + "; ".join(notes),
            flush=True,
        )
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
