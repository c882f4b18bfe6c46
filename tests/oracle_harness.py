"""Compare a registered Spark query with its DuckDB oracle (row count, column
names and types, order-insensitive exact values)."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

_TYPE_MAP = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT",
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _canon(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(float(v))
    if hasattr(v, "item"):
        return _canon(v.item())
    return repr(v)


def compare(spark, sf_dir: str, name: str, fn, sql: str | None, con=None) -> dict:
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_types = [(f.name, f.dataType.simpleString()) for f in sdf.schema.fields]
    s_rows = [tuple(r) for r in sdf.collect()]
    t_spark = time.time() - t0
    out = {"name": name, "rows": len(s_rows), "spark_sec": round(t_spark, 2)}
    if sql is None:
        out["status"] = "rows-only"
        return out
    con = con or duck(sf_dir)
    rel = con.execute(sql)
    d_cols = [d[0] for d in rel.description]
    d_types = [str(d[1]) for d in rel.description]
    d_rows = rel.fetchall()
    s_names = [n for n, _ in s_types]
    problems = []
    if sorted(s_names) != sorted(d_cols):
        problems.append(f"columns spark={s_names} duck={d_cols}")
    else:
        dt = dict(zip(d_cols, d_types))
        for n, t in s_types:
            want = _TYPE_MAP.get(t, t.upper())
            if want != dt[n]:
                problems.append(f"type {n}: spark={t} duck={dt[n]}")
    if len(s_rows) != len(d_rows):
        problems.append(f"rowcount spark={len(s_rows)} duck={len(d_rows)}")
    if not problems:
        order = sorted(range(len(s_names)), key=lambda i: s_names[i])
        d_idx = {c: i for i, c in enumerate(d_cols)}
        sv = sorted(tuple(_canon(r[i]) for i in order) for r in s_rows)
        dv = sorted(tuple(_canon(r[d_idx[s_names[i]]]) for i in order) for r in d_rows)
        if sv != dv:
            diff = [(a, b) for a, b in zip(sv, dv) if a != b][:3]
            problems.append(f"values differ, e.g. {diff}")
    out["status"] = "ok" if not problems else "MISMATCH"
    if problems:
        out["problems"] = problems
    return out


def main(sf_dir: str, only: list[str] | None = None):
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from vitrine.session import get_session

    spark = get_session()
    qs, os_ = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        try:
            res = compare(spark, sf_dir, name, fn, os_.get(name), con)
        except Exception as exc:  # report and go on
            res = {"name": name, "status": "ERROR", "error": repr(exc)[:500]}
        bad += res["status"] in ("MISMATCH", "ERROR")
        print(res, flush=True)
    return bad


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    sys.exit(1 if main(sf, sys.argv[2:] or None) else 0)
