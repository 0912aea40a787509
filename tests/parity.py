"""Run registered queries in Spark and their oracle SQL in DuckDB on the
same parquet tables and compare rows (order-insensitive, columns by name).

    python tests/parity.py [key ...] [--sf DIR]
"""

from __future__ import annotations

import argparse
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        if math.isnan(f):
            return "nan"
        r = round(f, 6)
        return 0.0 if r == 0 else r
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, norm(x)) for k, x in v.items())
    if hasattr(v, "asDict"):
        return tuple((k, norm(x)) for k, x in v.asDict().items())
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=repr)


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT",
                 "string": "VARCHAR", "boolean": "BOOLEAN", "smallint": "SMALLINT", "tinyint": "TINYINT"}


def duck_type(spark_type: str) -> str:
    if spark_type.startswith("array<"):
        return duck_type(spark_type[6:-1]) + "[]"
    return SPARK_TO_DUCK.get(spark_type, spark_type)


def duck(sf):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("keys", nargs="*")
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--show", type=int, default=3)
    a = ap.parse_args()
    from tessera.session import get_spark
    import __spark_entry__ as E
    spark = get_spark(8, 8)
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(a.sf)
    keys = a.keys or list(qs)
    bad = []
    for k in keys:
        t0 = time.time()
        try:
            df = qs[k](spark, a.sf)
            srows = df.collect()
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"{k:28s} SPARK-ERROR {str(e)[:400]}")
            bad.append(k)
            continue
        ts = time.time() - t0
        if k not in sqls:
            print(f"{k:28s} rows={len(srows)} (no oracle) {ts:.1f}s")
            continue
        try:
            rel = con.sql(sqls[k])
            dtypes = {n: str(t) for n, t in zip(rel.columns, rel.types)}
            stypes = {f.name: duck_type(f.dataType.simpleString()) for f in df.schema.fields}
            tbad = {c: (stypes.get(c), dtypes.get(c)) for c in set(stypes) | set(dtypes)
                    if stypes.get(c) != dtypes.get(c)}
            if tbad:
                print(f"{k:28s} TYPES differ {tbad}")
            cur = con.execute(sqls[k])
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{k:28s} SQL-ERROR {str(e)[:400]}")
            bad.append(k)
            continue
        sc, sr = canon(scols, srows)
        dc, dr = canon(dcols, drows)
        ok = sc == dc and sr == dr
        print(f"{k:28s} {'OK ' if ok else 'BAD'} spark={len(sr)} duck={len(dr)} {ts:.1f}s")
        if not ok:
            bad.append(k)
            if sc != dc:
                print("   cols spark", sc, "\n   cols duck ", dc)
            else:
                ss, ds = set(sr), set(dr)
                for r in list(ss - ds)[: a.show]:
                    print("   spark-only", str(r)[:600])
                for r in list(ds - ss)[: a.show]:
                    print("   duck-only ", str(r)[:600])
    print("BAD:", bad)


if __name__ == "__main__":
    main()
