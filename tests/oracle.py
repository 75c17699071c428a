"""Compare registered queries with their SQL on DuckDB. ``python tests/oracle.py sf0.01 [names...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float) and v == 0:
        return 0.0
    return v


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) if not isinstance(v, (int, float)) else (False, "n", v) for v in row)


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_plain(row[i]) for i in order) for row in data]
    return [cols[i] for i in order], sorted(out, key=_key)


def compare(spark, con, folder, name, fn, sql):
    """Empty text if equal, else what differs."""
    df = fn(spark, folder)
    c1, r1 = rows(df.columns, [tuple(x) for x in df.collect()])
    if sql is None:
        return "" if r1 else "no rows"
    cur = con.execute(sql)
    c2, r2 = rows([d[0] for d in cur.description], cur.fetchall())
    if c1 != c2:
        return f"columns {c1} vs {c2}"
    if len(r1) != len(r2):
        return f"{len(r1)} rows vs {len(r2)}"
    if not r1:
        return "no rows on either side"
    bad = [(a, b) for a, b in zip(r1, r2) if a != b]
    if bad:
        return f"{len(bad)} of {len(r1)} rows differ, first {bad[0]}"
    kinds = [(c, type(a).__name__, type(b).__name__) for c, a, b in zip(c1, r1[0], r2[0]) if type(a) is not type(b) and a is not None and b is not None]
    return f"types {kinds}" if kinds else ""


def main():
    from __spark_entry__ import oracle_sql, queries
    from plantframe.session import build_session

    folder = f"/root/testdata/{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g",
                              "spark.sql.ansi.enabled": os.environ.get("ANSI", "true")}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sql = oracle_sql()
    failed = []
    for name, fn in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        at = time.time()
        try:
            problem = compare(spark, con, folder, name, fn, sql.get(name))
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        print(f"{'ok  ' if not problem else 'FAIL'} {name} {time.time() - at:.1f}s {problem}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main()
