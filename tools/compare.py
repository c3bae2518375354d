"""Run registered queries on Spark and their SQL on DuckDB and compare the rows: python tools/compare.py [sf] [key...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

from provena.plans import registry
from provena.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else format(v + 0.0, ".9g")
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(norm(r[i]) for i in order) for r in rows)


TYPES = {"VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "BOOLEAN": "boolean",
         "TIMESTAMP": "timestamp", "DATE": "date", "SMALLINT": "smallint"}


def compare(spark, con, sf, key, fn, sql, verbose=True):
    t0 = time.time()
    df = fn(spark, sf)
    got = df.collect()
    t1 = time.time()
    if sql is None:
        return True, f"{len(got)} rows, no SQL", t1 - t0, 0.0
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    t2 = time.time()
    msg = []
    if sorted(cols) != sorted(df.columns):
        msg.append(f"columns {sorted(df.columns)} vs {sorted(cols)}")
    else:
        for name, dt in df.dtypes:
            if TYPES.get(types[name], types[name].lower()) != dt.replace("timestamp_ntz", "timestamp"):
                msg.append(f"type {name}: {dt} vs {types[name]}")
        a, b = rows_of(df.columns, [tuple(r) for r in got]), rows_of(cols, want)
        if a != b:
            sa, sb = set(a), set(b)
            msg.append(
                f"rows {len(a)} vs {len(b)}; only spark {len(sa - sb)}: {sorted(sa - sb)[:3]}; only sql {len(sb - sa)}: {sorted(sb - sa)[:3]}"
            )
    return not msg, f"{len(got)} rows " + "; ".join(msg)[:1500], t1 - t0, t2 - t1


def main() -> int:
    sf = "/root/testdata/sf" + (sys.argv[1] if len(sys.argv) > 1 else "0.01")
    wanted = sys.argv[2:]
    spark = local_session("compare", 8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    qs, sqls = registry.queries(), registry.oracle_sql()
    bad = 0
    for key, fn in qs.items():
        if wanted and key not in wanted:
            continue
        try:
            ok, msg, ts, td = compare(spark, con, sf, key, fn, sqls.get(key))
        except Exception as e:  # noqa: BLE001
            ok, msg, ts, td = False, f"{type(e).__name__}: {str(e)[:900]}", 0, 0
        bad += not ok
        print(f"{'ok  ' if ok else 'BAD '} {key:28s} spark {ts:6.2f}s sql {td:6.2f}s  {msg}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
