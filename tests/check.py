"""Run registered queries beside their SQL in DuckDB and compare whole results.

Usage: python tests/check.py [sf] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TIMES = {"spark": 0.0}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        frame[c] = frame[c].map(lambda v: "∅" if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else repr(v))
    return frame.sort_values(list(frame.columns), ignore_index=True)


def difference(spark, con, folder: str, fn, sql: str) -> str | None:
    """None when both results agree, else what differs."""
    t0 = time.time()
    got_raw = fn(spark, folder)
    table = got_raw.toArrow()
    TIMES["spark"] = time.time() - t0
    got = pd.DataFrame({c: pd.Series(table[c].to_pylist(), dtype=object) for c in table.column_names})
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    rows = cursor.fetchall()
    want = pd.DataFrame({n: pd.Series([r[j] for r in rows], dtype=object) for j, n in enumerate(names)})
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if not len(got):
        return "empty result"
    a, b = canonical(got), canonical(want)
    if a.equals(b):
        return None
    for c in a.columns:
        bad = a[c] != b[c]
        if bad.any():
            n = int(bad.sum())
            i = bad.idxmax()
            return f"column {c}: {n}/{len(a)} differ, e.g. {a.loc[i].to_dict()} vs {b.loc[i].to_dict()}"
    return "unknown difference"


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from wayside.session import local_session

    sf = argv[0] if argv else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark, con = local_session("8", "check"), connect(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = argv[1:] or list(queries)
    failed = 0
    for name in names:
        t0, TIMES["spark"] = time.time(), 0.0
        try:
            if name in oracle:
                problem = difference(spark, con, folder, queries[name], oracle[name])
            else:
                n = queries[name](spark, folder).count()
                problem = None if n else "no rows"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:28s} {TIMES['spark'] or time.time() - t0:6.2f}s of {time.time() - t0:6.2f}s "
              f"{'' if name in oracle else '(rows only) '}{(problem or '')[:1100]}", flush=True)
    print(f"{len(names) - failed}/{len(names)} agree")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
