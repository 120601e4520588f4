"""Run registered queries against their DuckDB counterparts.

    python tests/oracle.py [--dir DIR] [pattern ...]
"""

from __future__ import annotations

import decimal
import fnmatch
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def cell(x):
    if x is None:
        return "~"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (decimal.Decimal, float)):
        x = float(x)
        return "nan" if math.isnan(x) else f"{x:.6f}"
    if isinstance(x, int):
        return f"{float(x):.6f}" if abs(x) < 2**53 else str(x)
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(cell(y) for y in x) + "]"
    return str(x)


def compare(name, df, con, sql) -> str:
    """Empty text when the two results agree."""
    cols = sorted(df.columns)
    mine = sorted(tuple(cell(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} against {sorted(names)}"
    at = [names.index(c) for c in cols]
    theirs = sorted(tuple(cell(r[i]) for i in at) for r in cur.fetchall())
    if mine == theirs:
        return ""
    a, b = set(mine), set(theirs)
    return f"rows {len(mine)}/{len(theirs)} cols={cols}\n   spark only {[x for x in mine if x not in b][:2]}\n   check only {[x for x in theirs if x not in a][:2]}"


def main() -> int:
    args = sys.argv[1:]
    folder = "/root/testdata/sf0.001"
    if "--dir" in args:
        i = args.index("--dir")
        folder = args[i + 1]
        del args[i : i + 2]
    modules = []
    while "--only" in args:
        i = args.index("--only")
        modules.append(args[i + 1])
        del args[i : i + 2]
    from tallyspark.plans.session import build_session

    if modules:
        import importlib

        for m in modules:
            importlib.import_module(f"tallyspark.catalog.{m}")
        from tallyspark.catalog.registry import ORACLES, QUERIES
    else:
        from tallyspark.catalog.index import ORACLES, QUERIES
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name, fn in QUERIES.items():
        if args and not any(fnmatch.fnmatch(name, p) for p in args):
            continue
        t0 = time.time()
        try:
            df = fn(spark, folder)
            if name in ORACLES:
                why = compare(name, df, con, ORACLES[name])
                n = "checked"
            else:
                n = df.count()
                why = "" if n else "no rows"
        except Exception as e:  # noqa: BLE001
            why, n = f"{type(e).__name__} {str(e)[:700]}", "failed"
        bad += bool(why)
        print(f"{'BAD ' if why else 'ok  '}{name} {n} {time.time() - t0:.1f}s {why}", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
