"""Run a registered query on Spark and its oracle SQL on DuckDB; compare results.

Usable from pytest (``compare``) and from the command line:
    python tests/oracle_compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402
from pyspark.sql import Row  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def norm(v):
    """A hashable, engine-neutral form of a value (structs become sorted field tuples)."""
    if isinstance(v, Row):
        return tuple(sorted((k, norm(x)) for k, x in v.asDict(recursive=False).items()))
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, Decimal):
        return round(float(v), 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir) / f"{t}.parquet"
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, name: str, sf_dir: str, con=None) -> dict:
    from __spark_entry__ import oracle_sql, queries

    con = con or duck(sf_dir)
    t0 = time.time()
    df = queries()[name](spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(norm(r[c]) for c in s_cols) for r in df.collect()]
    t1 = time.time()
    sql = oracle_sql().get(name)
    out = {"query": name, "spark_rows": len(s_rows), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        out["status"] = "no-oracle"
        return out
    rel = con.sql(sql)
    d_cols = rel.columns
    d_rows = [tuple(norm(x) for x in r) for r in rel.fetchall()]
    out["oracle_rows"] = len(d_rows)
    if sorted(s_cols) != sorted(d_cols):
        out["status"] = f"columns differ: spark={sorted(s_cols)} oracle={sorted(d_cols)}"
        return out
    order = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
    d_index = {c: i for i, c in enumerate(d_cols)}
    s_sorted = sorted((tuple(r[i] for i in order) for r in s_rows), key=repr)
    d_sorted = sorted((tuple(r[d_index[s_cols[i]]] for i in order) for r in d_rows), key=repr)
    if s_sorted == d_sorted:
        out["status"] = "match"
    else:
        diff_s = [r for r in s_sorted if r not in set(d_sorted)][:2]
        diff_d = [r for r in d_sorted if r not in set(s_sorted)][:2]
        out["status"] = "values differ"
        out["spark_only"] = repr(diff_s)[:600]
        out["oracle_only"] = repr(diff_d)[:600]
    return out


def main(argv: list[str]) -> int:
    from __spark_entry__ import queries
    from visitlake.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(queries())
    spark = local_session("8")
    con = duck(sf_dir)
    bad = 0
    for n in names:
        try:
            r = compare(spark, n, sf_dir, con)
        except Exception as e:  # report and continue
            r = {"query": n, "status": f"error: {type(e).__name__}: {str(e)[:400]}"}
        bad += r["status"] not in ("match", "no-oracle")
        print(r, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
