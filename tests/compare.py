"""Comparison of a query with its SQL definition. Also a script: python -m tests.compare FOLDER [NAME …]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

from __spark_entry__ import oracle_sql, queries


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return con


def normalized(frame: pd.DataFrame) -> list[tuple]:
    def plain(value):
        if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
            return None
        if isinstance(value, bool) or type(value).__name__ == "bool_":
            return bool(value)
        if isinstance(value, (int, float)) or hasattr(value, "dtype"):
            return round(float(value), 4) + 0.0
        return str(value)

    columns = sorted(frame.columns)
    rows = [tuple(plain(v) for v in row) for row in frame[columns].itertuples(index=False)]
    return sorted(rows, key=lambda row: tuple((v is None, str(v)) for v in row))


def differences(
    spark, con: duckdb.DuckDBPyConnection, folder: str, name: str, plans: list[str] | None = None
) -> tuple[int, list[str]]:
    """Number of rows and what differs (nothing if equal); the plan is added to ``plans``."""
    result = queries()[name](spark, folder)
    if plans is not None:
        plans.append(result._jdf.queryExecution().executedPlan().toString())
    got = result.toPandas()
    want = con.execute(oracle_sql()[name]).df()
    if sorted(got.columns) != sorted(want.columns):
        return len(got), [f"columns {sorted(got.columns)} != {sorted(want.columns)}"]
    a, b = normalized(got), normalized(want)
    if a == b:
        return len(a), []
    missing, extra = sorted(set(b) - set(a), key=str), sorted(set(a) - set(b), key=str)
    return len(a), [f"rows {len(a)} != {len(b)}", f"missing {missing[:3]}", f"extra {extra[:3]}"]


if __name__ == "__main__":
    from tests.conftest import make_session

    session = make_session()
    folder = sys.argv[1]
    connection = connect(folder)
    for name in sys.argv[2:] or sorted(queries()):
        started = time.time()
        try:
            if name in oracle_sql():
                rows, wrong = differences(session, connection, folder, name)
            else:
                rows, wrong = queries()[name](session, folder).count(), ["no SQL"]
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            rows, wrong = -1, [f"{type(error).__name__}: {str(error)[:1500]}"]
        print(f"{'ok ' if not wrong else 'BAD'} {name} rows={rows} {time.time() - started:.1f}s", *wrong, flush=True)
