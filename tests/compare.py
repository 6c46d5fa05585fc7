"""Compares a registered query with its DuckDB counterpart, order aside."""

from __future__ import annotations

import os
import sys
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return None if v != v else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir: str, query, sql: str) -> list[str]:
    """Differences, empty if none."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con = duckdb.connect()
    con.execute("set memory_limit='5GB'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    res = con.execute(sql)
    names = [c[0] for c in res.description]
    want = rows_of(names, res.fetchall())
    out = []
    if sorted(names) != sorted(df.columns):
        out.append(f"columns {sorted(df.columns)} against {sorted(names)}")
    if got != want:
        out.append(f"rows {sum(got.values())} against {sum(want.values())}; only here {list((got - want).items())[:3]}; only there {list((want - got).items())[:3]}")
    return out


def main(names: list[str], sf_dir: str = os.environ.get("SF_DIR", "/root/testdata/sf0.01")) -> None:
    import time

    import __spark_entry__ as e
    from lexiloom.session import local

    spark = local()
    qs, os_ = e.queries(), e.oracle_sql()
    for n in names or sorted(os_):
        began = time.time()
        try:
            print(n, compare(spark, sf_dir, qs[n], os_[n]) if n in os_ else (qs[n](spark, sf_dir).count(), "rows, no SQL"), f"{time.time() - began:.1f} s", flush=True)
        except Exception as x:  # noqa: BLE001
            print(n, "ERROR", str(x)[:1500], flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
