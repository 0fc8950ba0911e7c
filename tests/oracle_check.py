"""Compare every query with its SQL: python tests/oracle_check.py [sf_dir] [names...]"""

from __future__ import annotations

import pathlib
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from parcela.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df.reindex(columns=sorted(df.columns))
    cells = []
    for name in df.columns:
        column = df[name]
        if str(column.dtype).startswith("datetime"):
            column = column.astype("datetime64[us]").astype(str)
        cells.append([None if v is None or v is pd.NA or (isinstance(v, float) and v != v) or v is pd.NaT
                      else float(v) + 0.0 if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)
                      for v in column])
    return sorted(zip(*cells), key=repr)


def differences(ours: pd.DataFrame, theirs: pd.DataFrame) -> list[str]:
    if sorted(ours.columns) != sorted(theirs.columns):
        return [f"columns {sorted(ours.columns)} / {sorted(theirs.columns)}"]
    a, b = canonical(ours), canonical(theirs)
    if len(a) != len(b):
        return [f"rows {len(a)} / {len(b)}"]
    return [f"{x} / {y}" for x, y in zip(a, b) if x != y]


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(queries())
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(sf_dir), oracle_sql(), 0
    for name in names:
        start = time.time()
        try:
            ours = queries()[name](spark, sf_dir).toPandas()
            took = time.time() - start
            if name not in sql:
                print(f"rows  {name:28} {len(ours):7d} rows {took:6.2f}s", flush=True)
                continue
            diff = differences(ours, con.execute(sql[name]).df())
        except Exception as error:  # report and go on with the next query
            diff, took, ours = [f"{type(error).__name__}: {str(error)[:600]}"], time.time() - start, []
        bad += bool(diff)
        print(f"{'BAD ' if diff else 'ok  '}  {name:28} {len(ours):7d} rows {took:6.2f}s", flush=True)
        for line in diff[:3]:
            print("       ", line[:700], flush=True)
        if diff:
            print("        differing:", len(diff), flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
