"""Run catalogue queries beside their SQL in DuckDB and compare the full result."""
from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def oracle_connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        return repr(v + 0.0)
    return str(v)


def normalised(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def compare(df, con, sql):
    """(ok, message); values are compared exactly, as text."""
    left, lcols = normalised(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    right, rcols = normalised([d[0] for d in cur.description], cur.fetchall())
    if lcols != rcols:
        return False, f"columns {lcols} != {rcols}"
    if len(left) != len(right):
        return False, f"rows {len(left)} != {len(right)}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        return False, f"{len(bad)}/{len(left)} rows differ\n   {lcols}\n   {bad[0][0]}\n   {bad[0][1]}"
    return True, f"{len(left)} rows"


def main(argv):
    from innings_engine.catalog import load
    from innings_engine.session import build_session

    sf = argv[0]
    names = argv[1:]
    queries, sqls = load()
    spark = build_session()
    sf_dir = f"/root/testdata/sf{sf}"
    con = oracle_connection(sf_dir)
    failed = []
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in sqls:
                ok, message = compare(df, con, sqls[name])
            else:
                n = len(df.collect())
                ok, message = True, f"{n} rows (no SQL)"
        except Exception as e:  # noqa: BLE001
            ok, message = False, f"{type(e).__name__}: {str(e)[:700]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {time.time() - start:6.1f}s  {message}", flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
