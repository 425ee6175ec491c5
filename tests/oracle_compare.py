"""Run registered Spark queries and their DuckDB oracle side by side.

Usable from pytest (``compare``) and as a script:
    python tests/oracle_compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v if os.environ.get("ORACLE_STRICT") else float(f"{v:.12g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


def compare(spark, con, name: str, fn, sql: str, sf_dir: str) -> dict:
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    rel = con.sql(sql)
    d_cols = rel.columns
    d_rows = rel.fetchall()
    res = {
        "name": name,
        "rows": (len(s_rows), len(d_rows)),
        "cols_ok": sorted(s_cols) == sorted(d_cols),
        "types": (
            [f.dataType.simpleString() for f in sorted(sdf.schema.fields, key=lambda f: f.name)],
            [str(t) for _, t in sorted(zip(rel.columns, rel.types))],
        ),
    }
    if not res["cols_ok"]:
        res["cols"] = (sorted(s_cols), sorted(d_cols))
        res["ok"] = False
        return res
    a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
    res["ok"] = a == b
    if not res["ok"]:
        diff_a = [r for r in a if r not in set(b)][:3]
        diff_b = [r for r in b if r not in set(a)][:3]
        res["sample"] = (sorted(s_cols), diff_a, diff_b)
    return res


_DUCK = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
    "boolean": "BOOLEAN",
}


def types_match(spark_types, duck_types) -> bool:
    for s, d in zip(spark_types, duck_types):
        want = _DUCK.get(s, s.upper())
        if want != d:
            return False
    return True


def main(argv):
    from pyspark.sql import SparkSession

    import __spark_entry__ as E

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or sorted(E.oracle_sql())
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", os.environ.get("ORACLE_TZ", "UTC"))
        .config("spark.sql.ansi.enabled", os.environ.get("ORACLE_ANSI", "true"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    q, o = E.queries(), E.oracle_sql()
    bad = 0
    for n in names:
        try:
            r = compare(spark, con, n, q[n], o[n], sf_dir)
        except Exception as ex:  # noqa: BLE001
            r = {"name": n, "ok": False, "error": repr(ex)[:600]}
        bad += not r["ok"]
        print(("OK  " if r["ok"] else "BAD ") + n, {k: v for k, v in r.items() if k not in ("name", "ok", "types")})
        if "types" in r and not types_match(*r["types"]):
            print("    TYPES", r["types"])
        if not r.get("ok") and "types" in r:
            print("    types", r["types"])
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv)
