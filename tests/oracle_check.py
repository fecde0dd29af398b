"""Runs registered queries beside their DuckDB statements: python tests/oracle_check.py SF_DIR [NAME...]"""

import os
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def normal(df: pd.DataFrame) -> pd.DataFrame:
    out = pd.DataFrame({c: df[c] for c in sorted(df.columns)})
    for c in out.columns:
        if str(out[c].dtype).startswith("datetime") or out[c].map(lambda x: hasattr(x, "isoformat")).any():
            out[c] = out[c].map(lambda x: None if x is None or x != x else str(x)[:10])
        elif out[c].dtype == object:
            out[c] = out[c].map(lambda x: float(x) if type(x).__name__ == "Decimal" else x)
    num = [c for c in out.columns if pd.api.types.is_numeric_dtype(out[c])]
    out[num] = out[num].astype(float) + 0.0
    keys = [c for c in out.columns if c not in num] + num
    return out.sort_values(keys, na_position="first").reset_index(drop=True)


def compare(spark, con, sf: str, f, sql: str) -> str:
    a, b = f(spark, sf).toPandas(), con.sql(sql).df()
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} {sorted(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} {len(b)}"
    x, y = normal(a), normal(b)
    for c in x.columns:
        numeric = pd.api.types.is_numeric_dtype(x[c]) and pd.api.types.is_numeric_dtype(y[c])
        same = ((x[c] - y[c]).abs() <= 1e-9 * y[c].abs().clip(lower=1)) | (x[c].isna() & y[c].isna()) if numeric else (x[c].astype(str) == y[c].astype(str)) | (x[c].isna() & y[c].isna())
        if not same.all():
            at = (~same).idxmax()
            return f"column {c}: {(~same).sum()} of {len(x)} differ, first {x.loc[at].to_dict()} {y.loc[at].to_dict()}"
    return f"ok {len(a)}"


def connect(sf: str):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from read_parquet('{p}{'/*' if p.is_dir() else ''}')")
    return con


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master(f"local[{os.environ.get('CPUS', 8)}]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, sf, names = connect(sys.argv[1]), sys.argv[1], sys.argv[2:]
    for name, f in e.queries().items():
        if names and name not in names or not names and (name.startswith("op") or name == "pipeline"):
            continue
        t = time.time()
        try:
            said = compare(spark, con, sf, f, e.oracle_sql()[name]) if name in e.oracle_sql() else f"rows only {f(spark, sf).count()}"
        except Exception as x:
            said = "ERR " + str(x)[:400].replace("\n", " ")
        print(f"{name}: {said} ({time.time() - t:.1f} s)", flush=True)
