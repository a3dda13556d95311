"""Runs queries and their SQL side by side: ``python tests/oracle.py SF_DIR [NAME...]``."""

import datetime
import math
import os
import sys
from collections import Counter

import duckdb


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            p = f"{sf_dir}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else "")
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{p}'")
    return con


def differences(spark, con, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    mine = Counter(tuple(norm(v) for v in r) for r in df.select(*cols).collect())
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    if sorted(names) != cols:
        return [f"columns {cols} and {sorted(names)}"]
    order = [names.index(c) for c in cols]
    types = {names[k]: str(cur.description[k][1]) for k in order}
    theirs = Counter(tuple(norm(r[k]) for k in order) for r in cur.fetchall())
    out = []
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    for c, t in df.dtypes:
        if kinds.get(t) != types[c].split("(")[0] and not (kinds.get(t), types[c]) in {("INTEGER", "INT32"), ("BIGINT", "INT64")}:
            out.append(f"type of {c}: {t} and {types[c]}")
    if mine != theirs:
        out.append(f"{sum(mine.values())} rows and {sum(theirs.values())}; only here {list((mine - theirs).items())[:2]}; only there {list((theirs - mine).items())[:2]}")
    return out


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import time

    import __spark_entry__ as entry

    from weftline.session import local_session

    spark = local_session("oracle")
    con = connect(sys.argv[1])
    q, sql = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or sql:
        t = time.time()
        try:
            d = differences(spark, con, q[name], sql[name], sys.argv[1])
        except Exception as e:
            d = [f"{type(e).__name__}: {str(e)[:600]}"]
        print(name, "ok" if not d else d, round(time.time() - t, 1), flush=True)
