"""Compare registered queries with their DuckDB SQL: ``python -m tests.compare [prefix ...]``."""

from __future__ import annotations

import glob
import os
import sys

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(str(r[i]) for i in order) for r in data))


def difference(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """What differs between both results, or None."""
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = rows(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    if got == want:
        return None
    a, b = sorted(set(got) - set(want)), sorted(set(want) - set(got))
    return f"rows {len(got)} / {len(want)}, differing {len(a)}; columns {sorted(names)}; spark {a[:1]} duckdb {b[:1]}"


def main() -> None:
    sys.path.insert(0, os.getcwd())
    import __spark_entry__ as entry
    from siemloom.session import get_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = get_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    for name, text in sql.items():
        if len(sys.argv) > 1 and not any(name.startswith(p) for p in sys.argv[1:]):
            continue
        try:
            result = difference(spark, con, queries[name], text, sf_dir)
        except Exception as e:  # report and go on
            result = "error " + str(e)[:400]
        print("OK" if result is None else "DIFF", name, result or "", flush=True)


if __name__ == "__main__":
    main()
