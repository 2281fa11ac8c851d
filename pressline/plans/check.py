"""Side-by-side check of registered queries against their DuckDB oracles.

Usage: ``python -m pressline.plans.check [sf_dir] [name ...]``. Prints one line
per query: row counts, column names and an order-insensitive value comparison
(exact for integers/strings/booleans; doubles compared after rounding to 9
significant digits, and reported separately when bit-exact).
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

from pressline.sources.tables import TABLES


_SPARK_TYPES = {"IntegerType()": "INTEGER", "LongType()": "BIGINT", "DoubleType()": "DOUBLE",
                "StringType()": "VARCHAR", "BooleanType()": "BOOLEAN", "FloatType()": "FLOAT",
                "TimestampNTZType()": "TIMESTAMP", "TimestampType()": "TIMESTAMP WITH TIME ZONE"}


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, exact: bool):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if exact:
            return repr(v)
        return float(f"{v:.9g}")
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, exact) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, exact)) for k, x in v.items()))
    return v


def _rows(pdf, exact: bool):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(None if (x is None or (isinstance(x, float) and False)) else _norm(x, exact) for x in rec))
    return cols, sorted(out, key=repr)


def compare(spark, sf_dir: str, names: list[str] | None = None, verbose: bool = True) -> dict:
    from pressline.plans.registry import ORACLE, QUERIES, load_all

    load_all()
    con = duck(sf_dir)
    results = {}
    for name in names or sorted(QUERIES):
        t0 = time.time()
        rec = {"name": name}
        try:
            sdf = QUERIES[name](spark, sf_dir)
            sp = sdf.toPandas()
            rec["spark_rows"] = len(sp)
            rec["spark_sec"] = round(time.time() - t0, 2)
            if name in ORACLE:
                types = {f.name: _SPARK_TYPES.get(repr(f.dataType), repr(f.dataType)) for f in sdf.schema.fields}
                duck_types = {r[0]: r[1] for r in con.execute("DESCRIBE " + ORACLE[name]).fetchall()}
                rec["types_match"] = types == duck_types
                if not rec["types_match"]:
                    rec["types"] = {c: (types.get(c), duck_types.get(c)) for c in set(types) | set(duck_types)
                                    if types.get(c) != duck_types.get(c)}
                dp = con.execute(ORACLE[name]).fetchdf()
                rec["oracle_rows"] = len(dp)
                sc, sr = _rows(sp, False)
                dc, dr = _rows(dp, False)
                rec["cols_match"] = sc == dc
                rec["values_match"] = sr == dr
                rec["exact_match"] = _rows(sp, True)[1] == _rows(dp, True)[1]
                if not rec["cols_match"]:
                    rec["cols"] = (sc, dc)
                elif not rec["values_match"]:
                    diff = [x for x in sr if x not in set(dr)][:3]
                    diff2 = [x for x in dr if x not in set(sr)][:3]
                    rec["diff"] = (diff, diff2)
            else:
                rec["oracle"] = "rows-only"
        except Exception as e:  # report and continue
            rec["error"] = f"{type(e).__name__}: {str(e)[:800]}"
        rec["sec"] = round(time.time() - t0, 2)
        results[name] = rec
        if verbose:
            ok = rec.get("values_match") and rec.get("types_match", True)
            flag = "OK " if ok else ("ROW" if rec.get("oracle") else "ERR" if "error" in rec else "BAD")
            if ok and not rec.get("exact_match"):
                flag = "OK~"
            print(flag, name, {k: v for k, v in rec.items() if k not in ("name",)}, flush=True)
    return results


if __name__ == "__main__":
    from pressline.session import get_spark

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = get_spark("local[8]", 8)
    res = compare(spark, sf, names)
    bad = [n for n, r in res.items() if not (r.get("values_match") or r.get("oracle") == "rows-only")]
    print("FAILED:", bad)
