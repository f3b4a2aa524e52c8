"""Runs registered queries next to their SQL and compares the results.

    python -m tests.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int):
        return repr(float(value))
    if hasattr(value, "as_tuple"):
        return repr(float(value))
    return str(value)


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(str(plain(r[i])) for i in order) for r in rows)


def compare(spark, con, name, sf_dir):
    """None when equal, else a message."""
    from registered import ORACLES, QUERIES

    df = QUERIES[name](spark, sf_dir)
    got_columns, got = as_rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        return None if got else "no rows"
    cursor = con.execute(ORACLES[name])
    want_columns, want = as_rows([d[0] for d in cursor.description], cursor.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} vs {want_columns}"
    if not want:
        return "the SQL gives no rows" if not got else f"{len(got)} rows vs 0"
    if got != want:
        only = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
        return f"{len(got)} vs {len(want)} rows; spark only {only[0]}; sql only {only[1]}"
    return None


def main() -> None:
    from registered import ORACLES, QUERIES, load_all
    from tests.session import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    load_all()
    spark, con = local_session(), connect(sf_dir)
    names = [n for n in QUERIES if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    bad = 0
    for name in names:
        start = time.time()
        try:
            message = compare(spark, con, name, sf_dir)
        except Exception as error:  # report and go on
            message = "".join(traceback.format_exception_only(error))[:600]
        bad += message is not None
        print(f"{'FAIL' if message else 'ok  '} {name} {time.time() - start:.1f}s {'sql' if name in ORACLES else 'rows'} {message or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")


if __name__ == "__main__":
    main()
