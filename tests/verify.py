"""Compare queries with their SQL at a scale factor: python tests/verify.py DIR [NAME...]."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def canon(df: pd.DataFrame) -> pd.DataFrame:
    """Columns and rows in a fixed order, values as text."""

    def cell(x):
        if isinstance(x, float):
            return "nan" if x != x else repr(x)
        if hasattr(x, "tolist"):
            x = x.tolist()
        if isinstance(x, (list, tuple)):
            return repr([cell(y) for y in x])
        if x is None or x is pd.NaT:
            return "null"
        return str(x)

    df = df[sorted(df.columns)]
    out = pd.DataFrame({c: [cell(x) for x in df[c].astype(object)] for c in df.columns})
    return out.sort_values(list(out.columns)).reset_index(drop=True) if len(out.columns) else out


def kinds(df: pd.DataFrame) -> dict[str, str]:
    return {c: str(t).lower().replace("[us]", "").replace("[ns]", "") for c, t in df.dtypes.items()}


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = canon(got), canon(want)
    if not a.equals(b):
        diff = (a != b).any(axis=1)
        return f"{int(diff.sum())} rows differ, first:\n{a[diff].head(2).to_dict('records')}\n{b[diff].head(2).to_dict('records')}"
    odd = {c: (kinds(got)[c], kinds(want)[c]) for c in got.columns if len(got) and kinds(got)[c] != kinds(want)[c]}
    return f"types {odd}" if odd else ""


def main() -> int:
    import __spark_entry__ as e

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = session(), duck(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    qs, sql, bad = e.queries(), e.oracle_sql(), 0
    for name in names or qs:
        t = time.time()
        try:
            got = qs[name](spark, sf_dir).toPandas()
            took = time.time() - t
            said = compare(got, con.execute(sql[name]).df()) if name in sql else "no sql"
        except Exception as x:  # noqa: BLE001
            said, took, got = f"ERROR {str(x)[:1500]}", time.time() - t, []
        bad += said not in ("", "no sql")
        print(f"{name}: {len(got)} rows, {took:.1f} s, {said or 'equal'}", flush=True)
    print("bad:", bad)
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main())
