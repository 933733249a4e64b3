"""Run registered queries against their DuckDB oracles (like the driver).

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import math
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return repr(v + 0.0)  # exact: both sides round in SQL/Spark, nothing is re-rounded here
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


SPARK_TO_DUCK = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE",
                 "boolean": "BOOLEAN", "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT"}


def _duck_type(t):
    if t is None:
        return None
    t = str(t).upper()
    return {"STRING": "VARCHAR", "NUMBER": "DOUBLE"}.get(t, t)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    srows = [tuple(r) for r in df.collect()]
    scols = df.columns
    t1 = time.time()
    if sql is None:
        return {"name": name, "rows": len(srows), "oracle": None, "sec": round(t1 - t0, 2)}
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    sh, sl = digest(scols, srows)
    dh, dl = digest(dcols, drows)
    stypes = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    dtypes = {d[0]: str(d[1]) for d in res.description}
    type_diff = {c: (stypes.get(c), dtypes.get(c)) for c in set(stypes) | set(dtypes)
                 if stypes.get(c) != _duck_type(dtypes.get(c))}
    out = {"name": name, "rows": len(srows), "oracle_rows": len(drows),
           "cols_match": sorted(scols) == sorted(dcols), "hash_match": sh == dh, "types_match": not type_diff,
           "sec": round(t1 - t0, 2)}
    if type_diff:
        out["type_diff"] = type_diff
    if not (out["cols_match"] and out["hash_match"]):
        out["spark_cols"] = sorted(scols)
        out["duck_cols"] = sorted(dcols)
        diff_s = sorted(set(sl) - set(dl))[:3]
        diff_d = sorted(set(dl) - set(sl))[:3]
        out["only_spark"] = [x[:300] for x in diff_s]
        out["only_duck"] = [x[:300] for x in diff_d]
    return out


def main():
    import os
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as E
    from foldwise.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session("local[8]", 8)
    con = duck(sf_dir)
    qs, os_ = E.queries(), E.oracle_sql()
    bad = 0
    for name in (names or sorted(qs)):
        try:
            r = compare(spark, con, name, qs[name], os_.get(name), sf_dir)
        except Exception as e:  # report and continue
            r = {"name": name, "error": repr(e)[:800]}
        ok = r.get("oracle") is None and "error" not in r or (r.get("cols_match") and r.get("hash_match"))
        if ok and r.get("types_match") is False:
            print("TYPES " + str(r.get("type_diff")))
        bad += 0 if ok else 1
        print(("OK   " if ok else "FAIL ") + str(r), flush=True)
    print(f"{bad} failing")


if __name__ == "__main__":
    main()
