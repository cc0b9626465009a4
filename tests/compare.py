"""Run registered queries next to their SQL and compare the values.

``python tests/compare.py [folder] [name or prefix …]``
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def _cell(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    return value


def _key(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


def differences(spark_df, con, sql: str) -> list[str]:
    """What differs between a Spark result and a SQL result; empty if nothing."""
    answer = con.execute(sql)
    names = [d[0] for d in answer.description]
    expected = [tuple(r) for r in answer.fetchall()]
    out = []
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} != {sorted(names)}"]
    order = sorted(names)
    place = [names.index(n) for n in order]
    want = sorted([tuple(_cell(r[i]) for i in place) for r in expected], key=_key)
    have = sorted([tuple(_cell(r[n]) for n in order) for r in spark_df.collect()], key=_key)
    if len(want) != len(have):
        out.append(f"rows {len(have)} != {len(want)}")
    wrong = [(h, w) for h, w in zip(have, want) if h != w]
    if wrong:
        out.append(f"{len(wrong)} rows differ, first {dict(zip(order, zip(*wrong[0])))}")
    kinds = {type(v) for r in have for v in r} ^ {type(v) for r in want for v in r}
    if kinds - {type(None)} and not wrong:
        out.append(f"types differ: {kinds}")
    return out


def main() -> int:
    import __spark_entry__ as entry
    from signalsift.session import build_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sql = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            if name in sql:
                found = differences(run(spark, folder), con, sql[name])
            else:
                found = [] if run(spark, folder).count() else ["no rows"]
        except Exception as problem:  # noqa: BLE001
            found = [f"{type(problem).__name__}: {str(problem)[:600]}"]
        bad += bool(found)
        kind = "sql" if name in sql else "rows"
        print(f"{'FAIL' if found else 'ok  '} {name:34s} {kind} {time.time() - start:6.2f}s {'; '.join(found)}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
