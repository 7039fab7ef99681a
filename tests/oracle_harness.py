"""Run a registered Spark plan and its DuckDB SQL side by side and compare the results.

Usage as a script: ``python tests/oracle_harness.py [sf_dir] [name ...]``.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gradebook.session import TABLES, local_session  # noqa: E402,F401


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, digits: int):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, digits)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, digits)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict(), digits)
    return v


def _key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


def compare(spark, con, name: str, plan, sql: str, sf_dir: str, digits: int = int(os.environ.get("ORACLE_DIGITS", "6"))):
    t0 = time.time()
    sdf = plan(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    t2 = time.time()
    problems = []
    if sorted(s_cols) != sorted(d_cols):
        problems.append(f"columns spark={s_cols} duck={d_cols}")
        return problems, (t1 - t0, t2 - t1)
    order = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
    d_index = [d_cols.index(s_cols[i]) for i in order]
    s_norm = sorted((tuple(_norm(r[i], digits) for i in order) for r in s_rows), key=_key)
    d_norm = sorted((tuple(_norm(r[i], digits) for i in d_index) for r in d_rows), key=_key)
    if len(s_norm) != len(d_norm):
        problems.append(f"rows spark={len(s_norm)} duck={len(d_norm)}")
    if s_norm != d_norm:
        diff = [(a, b) for a, b in zip(s_norm, d_norm) if a != b][:3]
        problems.append(f"values differ, first: {diff}")
    return problems, (t1 - t0, t2 - t1)


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    import __spark_entry__ as entry

    spark = local_session()
    con = duck(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, plan in qs.items():
        if names and name not in names:
            continue
        if name not in sqls:
            n = plan(spark, sf_dir).count()
            print(f"ROWS  {name}: {n} rows (no oracle)")
            continue
        try:
            problems, (ts, td) = compare(spark, con, name, plan, sqls[name], sf_dir)
        except Exception as e:  # noqa: BLE001
            problems, ts, td = [f"error: {type(e).__name__}: {str(e)[:400]}"], 0, 0
        status = "OK   " if not problems else "FAIL "
        bad += bool(problems)
        print(f"{status}{name}: spark {ts:.2f}s duck {td:.2f}s {'; '.join(problems)}")
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv))
