"""Run registered queries and their DuckDB counterparts on one data folder and compare.

python tests/check_oracles.py [folder] [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(str(cell(r[i])) for i in order) for r in data])


KINDS = {"bigint": "int64", "int": "int32", "double": "float64", "string": "str", "boolean": "bool"}
SQL_KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
    "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "DATE": "date",
}


def compare(df, con, sql: str) -> tuple[str, int]:
    """'' if both results are equal, else what differs; and the row count."""
    got = df.collect()
    rel = con.sql(sql)
    names, types = rel.columns, [str(t) for t in rel.types]
    want = rel.fetchall()
    problems = []
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}", len(got)
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema}
    for n, t in zip(names, types):
        if SQL_KINDS.get(t, t) != spark_types[n]:
            problems.append(f"type of {n}: {spark_types[n]} / {t}")
    a, b = rows(df.columns, got), rows(names, want)
    if len(a) != len(b):
        problems.append(f"{len(a)} / {len(b)} rows")
    if a != b:
        only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
        problems.append(f"{len(only_a)} rows differ: {sorted(names)} {only_a[:2]} / {only_b[:2]}")
    return "; ".join(problems), len(got)


def main(folder: str, prefixes: list[str]) -> int:
    from barloom.plans import QUERIES, SQL
    from barloom.session import local_session

    spark, con, bad = local_session(), connect(folder), 0
    for name, fn in QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            if name in SQL:
                problem, n = compare(df, con, SQL[name])
            else:
                problem, n = "", len(df.collect())
        except Exception as exc:  # noqa: BLE001
            problem, n = f"{type(exc).__name__}: {str(exc)[:600]}", -1
        bad += bool(problem)
        kind = "sql " if name in SQL else "rows"
        print(f"{'BAD' if problem else 'ok '} {kind} {name} {n} rows {time.time() - start:.1f}s {problem}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    sys.exit(bool(main(args[0] if args else "/root/testdata/sf0.01", args[1:])))
