"""Run registered queries in Spark and their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return value + 0.0
    if isinstance(value, list):
        return tuple(_plain(v) for v in value)
    return value


def _key(row):
    return tuple((v is not None, str(type(v)), v if v is not None else 0) for v in row)


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(_plain(r[i]) for i in order) for r in data]
    return sorted(columns), sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; extra {list(set(got) - set(want))[:2]} missing {list(set(want) - set(got))[:2]}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ {got_cols}: {bad[0][0]} != {bad[0][1]}"
    kinds = {}
    for cols, rows, side in ((got_cols, got, "spark"), (want_cols, want, "sql")):
        for i, c in enumerate(cols):
            kinds.setdefault(c, {})[side] = {type(r[i]) for r in rows if r[i] is not None}
    wrong = {c: k for c, k in kinds.items() if k["spark"] != k["sql"]}
    return f"types {wrong}" if wrong else None


def main(sf: str, names: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from candlewick.session import build_session

    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, failed = connect(sf), oracle_sql(), 0
    for name, fn in queries().items():
        if names and not any(n in name for n in names):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in oracles:
                problem = compare(df, con, oracles[name])
                n = None
            else:
                n, problem = df.count(), None
        except Exception as e:  # noqa: BLE001
            problem, n = f"{type(e).__name__}: {str(e)[:1500]}", None
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - t:.1f}s" + (f" rows={n}" if n is not None else "") + (f"\n     {problem[:1500]}" if problem else ""), flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1], sys.argv[2:]) > 0)
