"""Run catalogue queries next to their DuckDB SQL and compare every value.

usage: python tools/check.py SF_DIR [NAME ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from loomline.queries.catalogue import ORACLES, QUERIES  # noqa: E402
from loomline.session import local_session  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(os.path.join(folder, "*.parquet")):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def cell(v: object) -> str:
    """Exact: whole numbers and doubles differ, and so do the two zeros."""
    return "NULL" if v is None else repr(v) if isinstance(v, (int, float)) else str(v)


def normalise(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, folder: str, name: str) -> str:
    """'' when equal, else what differs first."""
    df = QUERIES[name](spark, folder)
    got_cols, got = normalise(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        return "" if got_cols else "no columns"
    want = con.execute(ORACLES[name])
    want_cols, want_rows = normalise([d[0] for d in want.description], want.fetchall())
    if got_cols != want_cols:
        return f"columns differ: {sorted(set(got_cols) ^ set(want_cols))[:8]}"
    if len(got) != len(want_rows):
        return f"{len(got)} rows, expected {len(want_rows)}"
    for a, b in zip(got, want_rows):
        if a != b:
            return "values differ: " + str([(c, x, y) for c, x, y in zip(got_cols, a, b) if x != y][:6])
    return ""


def main() -> int:
    folder, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark, con, bad = local_session(), connect(folder), 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, folder, name)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(problem)
        mark = "ok  " if not problem else "FAIL"
        print(f"{mark} {name:28s} {time.time() - start:6.1f}s {'' if name in ORACLES else '(no sql) '}{problem}", flush=True)
    print(f"{len(names) - bad} of {len(names)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(main())
