"""Runs registered queries against their SQL: ``python -m tests.compare [folder] [name ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sql: str, folder: str) -> str:
    """Empty text when equal, else the first difference."""
    df = query(spark, folder)
    got = _rows(df.columns, df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = _rows(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    duck = {d[0]: str(d[1]).upper() for d in result.description}
    alike = {
        "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
        "date": "DATE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
    }
    types = [f"{n}: {t} / {duck[n]}" for n, t in df.dtypes if alike.get(t, t) != duck[n]]
    if types:
        return f"types {types}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} of {len(got)} rows differ, first {bad[0]}" if bad else ""


def main() -> None:
    import __spark_entry__ as entry
    from harborline.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = local_session(), connect(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or queries:
        t = time.time()
        try:
            if name in oracle:
                answer = compare(spark, con, queries[name], oracle[name], folder) or "ok"
            else:
                answer = f"rows only: {queries[name](spark, folder).count()}"
        except Exception as e:  # keep going: this is a report
            answer = f"error {type(e).__name__}: {str(e)[:600]}"
        print(f"{name:28s} {time.time() - t:6.2f}s  {answer}", flush=True)


if __name__ == "__main__":
    main()
