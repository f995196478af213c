"""Run registered plans beside their SQL twins and compare rows.

    python check.py [--sf 0.01] [--show] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import datetime
import math
import sys
import time
import traceback

import duckdb

from threadgauge.plans.registry import load, queries
from threadgauge.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(round(value + 0.0, 6))
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def family(name: str) -> str:
    low = name.lower()
    if any(k in low for k in ("int", "long", "short")):
        return "int"
    if any(k in low for k in ("double", "float", "decimal")):
        return "float"
    return low


def main() -> int:
    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="0.01")
    args.add_argument("--show", action="store_true")
    args.add_argument("names", nargs="*")
    opts = args.parse_args()
    folder = f"/root/testdata/sf{opts.sf}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    spark = local_session()
    bad = 0
    plans = load()
    for name, run in queries().items():
        if opts.names and not any(name.startswith(n) for n in opts.names):
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            cols = sorted(df.columns)
            got = sorted(tuple(plain(v) for v in r) for r in df.select(*cols).collect())
            took = time.time() - start
            types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: {type(e).__name__}: {str(e)[:700]}")
            if opts.show:
                traceback.print_exc()
            continue
        sql = plans[name].sql
        if not sql:
            print(f"rows {name}: {len(got)} rows {took:.1f}s (no SQL)")
            continue
        try:
            start = time.time()
            res = con.execute(sql)
            names = [d[0] for d in res.description]
            dtypes = {d[0]: str(d[1]) for d in res.description}
            rows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name} (SQL): {str(e)[:700]}")
            continue
        order = [names.index(c) for c in sorted(names)]
        want = sorted(tuple(plain(r[i]) for i in order) for r in rows)
        if sorted(names) != cols:
            bad += 1
            print(f"FAIL {name}: columns {cols} vs {sorted(names)}")
        elif got != want:
            bad += 1
            print(f"FAIL {name}: {len(got)} rows vs {len(want)}")
            a, b = set(got), set(want)
            print("   cols ", cols)
            for r in sorted(a - b)[:3]:
                print("   spark", str(r)[:600])
            for r in sorted(b - a)[:3]:
                print("   sql  ", str(r)[:600])
        else:
            note = ""
            for c in cols:
                fs, fd = family(types[c]), family(dtypes[c])
                if (fs == "int") != (fd == "int" or fd == "number") and fs in ("int", "float") and "HUGE" in dtypes[c]:
                    note += f" type {c}: {types[c]}/{dtypes[c]}"
                if "HUGE" in dtypes[c] or "DECIMAL" in dtypes[c] or "decimal" in types[c]:
                    note += f" type {c}: {types[c]}/{dtypes[c]}"
            flag = " EMPTY" if not got else ""
            print(f"ok   {name}: {len(got)} rows {took:.1f}s{flag}{note}")
    print("failures", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
