"""Run a registered query and its SQL on the same tables and compare rows, columns and values."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canon(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int,)):
        return str(float(v)) if abs(v) < 1 << 53 else str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return str(round(v, 6) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(canon, v)) + "]"
    return str(v)


def compare(spark, con, sf, name, fn, sql):
    """None when equal, else a short description of the difference."""
    df = fn(spark, sf)
    cols = sorted(df.columns)
    got = [tuple(canon(r[c]) for c in cols) for r in df.collect()]
    if sql is None:
        return None if got else "no rows"
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != cols:
        return f"columns {sorted(set(names) ^ set(cols))}"
    at = [names.index(c) for c in cols]
    want = [tuple(canon(r[i]) for i in at) for r in rel.fetchall()]
    if not want:
        return "the SQL gives no rows"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    a, b = sorted(got), sorted(want)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        x, y = bad[0]
        return f"{len(bad)} rows differ, first: " + str([(c, p, q) for c, p, q in zip(cols, x, y) if p != q][:6]) + f" row {x[:8]}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from hoopspark.registry.catalog import oracle_sql, queries
    from hoopspark.session import local_session

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    con = duck(sf)
    qs, sqls = queries(), oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        t = time.time()
        try:
            problem = compare(spark, con, sf, name, fn, sqls.get(name))
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name:32s} {time.time() - t:6.2f}s {'' if name in sqls else '(rows only) '}{problem or ''}", flush=True)
    print("bad:", bad, "of", len(qs))
