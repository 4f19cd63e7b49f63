"""Compare registered queries with their checking SQL.

Usage: python check.py [--sf FOLDER] [NAME ...]
"""

from __future__ import annotations

import argparse
import math
import time

import duckdb

from sitesift.plans.bindings import TABLES
from sitesift.session import local_session


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    named = [tuple(normal(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(named, key=repr)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--explain", action="store_true")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    from sitesift.plans.catalog import ORACLES, QUERIES

    spark = local_session(8, "check")
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{args.sf}/{name}.parquet'")
    bad = 0
    for name in args.names or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](spark, args.sf)
            if args.explain:
                df.explain("formatted")
            cols, got = table(df.columns, [tuple(r) for r in df.collect()])
            types = sorted((f.name, f.dataType.simpleString()) for f in df.schema)
            took = time.time() - start
            if name not in ORACLES:
                print(f"{name}: rows-only {len(got)} {took:.1f}s", flush=True)
                if not got:
                    bad += 1
                    print("  EMPTY")
                continue
            cursor = db.execute(ORACLES[name])
            dcols = [d[0] for d in cursor.description]
            dtypes = sorted((d[0], str(d[1])) for d in cursor.description)
            dcols, want = table(dcols, cursor.fetchall())
            ok = cols == dcols and got == want
            print(f"{name}: {'ok' if ok else 'DIFFERENT'} {len(got)}/{len(want)} {took:.1f}s",
                  flush=True)
            if not got:
                print("  EMPTY")
            if not ok:
                bad += 1
                print("  spark", types, "\n  sql  ", dtypes)
                wanted_rows, got_rows = set(want), set(got)
                extra = [r for r in got if r not in wanted_rows][:3]
                missing = [r for r in want if r not in got_rows][:3]
                print("  only spark", extra, "\n  only sql  ", missing)
            pairs = dict(dtypes)
            for column, kind in types:
                wanted = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
                          "string": "VARCHAR", "boolean": "BOOLEAN"}.get(kind)
                if wanted is None or pairs.get(column) != wanted:
                    print(f"  TYPE {column}: {kind} / {pairs.get(column)}")
        except Exception as error:  # keep going: this is a report
            bad += 1
            print(f"{name}: ERROR {str(error)[:1500]}", flush=True)
    print("problems:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(min(main(), 1))
