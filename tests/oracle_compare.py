"""Spark query vs DuckDB oracle comparison (row count, column names,
order-insensitive values), as the driver's correctness gate does it."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, float):
        if math.isnan(v):
            return (2, "nan")
        return (2, f"{round(v, 6):.6f}")
    if isinstance(v, int):
        return (2, f"{float(v):.6f}") if abs(v) < 2 ** 53 else (3, str(v))
    return (4, str(v))


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, sf_dir):
    t0 = time.time()
    sdf = query(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    t2 = time.time()
    ok_cols = sorted(s_cols) == sorted(d_cols)
    ok_n = len(s_rows) == len(d_rows)
    ok_v = ok_cols and rows_of(s_cols, s_rows) == rows_of(d_cols, d_rows)
    return dict(name=name, ok=ok_cols and ok_n and ok_v, cols=ok_cols, rows=(len(s_rows), len(d_rows)),
                values=ok_v, spark_s=round(t1 - t0, 2), duck_s=round(t2 - t1, 2),
                s_cols=s_cols, d_cols=d_cols)


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from driftmark.session import get_spark
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    spark = get_spark()
    con = duck(sf_dir)
    qs, os_ = E.queries(), E.oracle_sql()
    bad = 0
    for name in (names or list(qs)):
        if name not in os_:
            t0 = time.time()
            n = qs[name](spark, sf_dir).count()
            print(f"ROWS-ONLY {name}: {n} rows ({time.time() - t0:.1f}s)")
            continue
        try:
            r = compare(spark, con, name, qs[name], os_[name], sf_dir)
        except Exception as e:  # report and continue
            print(f"ERROR {name}: {type(e).__name__}: {str(e).splitlines()[0][:300]}")
            bad += 1
            continue
        flag = "OK  " if r["ok"] else "FAIL"
        bad += not r["ok"]
        extra = "" if r["cols"] else f" cols spark={r['s_cols']} duck={r['d_cols']}"
        print(f"{flag} {name}: rows={r['rows']} values={r['values']} "
              f"spark={r['spark_s']}s duck={r['duck_s']}s{extra}")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv))
