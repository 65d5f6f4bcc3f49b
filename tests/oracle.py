"""Runs named queries in Spark and DuckDB and compares whole results.

    python -m tests.oracle [sf] [name ...]
"""

from __future__ import annotations

import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        return v.item() if hasattr(v, "item") else v

    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir: str, name: str, run, sql: str | None) -> str:
    """Empty when equal, else what differs."""
    df = run(spark, sf_dir)
    got = _rows(df.columns, df.collect())
    if sql is None:
        return "" if got else "no rows"
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = _rows(columns, cur.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}: {_first(got, want)}"
    return "" if list(map(repr, got)) == list(map(repr, want)) else _first(got, want)


def _first(got, want) -> str:
    a, b = set(map(repr, got)), set(map(repr, want))
    return f"only spark {sorted(a - b)[:2]} | only sql {sorted(b - a)[:2]}"[:1500]


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from foliant.session import build_session

    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    names = argv[1:]
    spark = build_session(8, **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    oracles, bad = entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            diff = compare(spark, con, sf_dir, name, run, oracles.get(name))
        except Exception as e:  # keep going, report all
            diff = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(diff)
        kind = "sql" if name in oracles else "rows"
        print(f"{'FAIL' if diff else 'ok  '} {kind:4} {time.time() - start:6.1f}s {name} {diff}", flush=True)
    print(f"{bad} failures")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
