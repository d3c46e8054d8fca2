"""Run registered queries on Spark and their SQL twins on DuckDB and compare all values.

    python tools/check.py [--sf 0.01] [name-or-prefix ...]
"""

from __future__ import annotations

import argparse
import importlib.util
import math
import pathlib
import sys
import time

import duckdb

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "~" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(norm(x) for x in v.values()) + "}"
    return str(v)


def table_rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spec = importlib.util.spec_from_file_location("entry", ROOT / "__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    from parlor.session import local_session

    spark = local_session()
    sf = f"/root/testdata/sf{args.sf}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    q, o = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in q:
        if args.names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in args.names):
            continue
        t0 = time.time()
        try:
            df = q[name](spark, sf)
            rows = df.toArrow().to_pylist()
            cols = df.columns
            rows = [[r[c] for c in cols] for r in rows]
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERROR {name}: spark: {str(e)[:500]}", flush=True)
            continue
        t1 = time.time()
        if name not in o:
            print(f"rows  {name}: {len(rows)} rows {t1 - t0:.1f}s", flush=True)
            continue
        try:
            cur = con.execute(o[name])
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
            dtypes = {d[0]: str(d[1]) for d in cur.description}
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERROR {name}: duckdb: {str(e)[:500]}", flush=True)
            continue
        t2 = time.time()
        types = dict(df.dtypes)
        alias = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE"}
        off = [f"{c}:{types[c]}/{dtypes.get(c)}" for c in cols if types[c].split()[0] in alias and alias[types[c].split()[0]] != dtypes.get(c)]
        if sorted(cols) != sorted(dcols):
            bad += 1
            print(f"FAIL  {name}: columns {sorted(cols)} / {sorted(dcols)}", flush=True)
            continue
        a, b = table_rows(cols, rows), table_rows(dcols, drows)
        if a == b and not off:
            print(f"ok    {name}: {len(a)} rows spark {t1 - t0:.1f}s duckdb {t2 - t1:.1f}s" + ("  (EMPTY)" if not a else ""), flush=True)
        else:
            bad += 1
            sa, sb = set(a), set(b)
            print(f"FAIL  {name}: {len(a)} / {len(b)} rows, types {off}\n   cols {sorted(cols)}\n   spark only {sorted(sa - sb)[:3]}\n   duckdb only {sorted(sb - sa)[:3]}", flush=True)
    print("bad", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
