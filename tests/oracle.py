"""Side-by-side run of registered queries and their SQL.

As a script: ``python tests/oracle.py [sf_dir] [name ...]``.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def sql_rows(con, sql: str):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return names, cursor.fetchall()


def normal(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float):
            return repr(v + 0.0)
        if isinstance(v, bool):
            return str(v)
        return None if v is None else str(v)

    def kind(v):
        return "float" if isinstance(v, float) else "bool" if isinstance(v, bool) else (
            "int" if isinstance(v, int) else "str"
        )

    return sorted(
        tuple(("", "") if r[i] is None else (kind(r[i]), cell(r[i])) for i in order) for r in rows
    )


KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def differences(spark, con, sf_dir: str, fn, sql: str) -> str | None:
    """None where both sides give the same columns and rows, otherwise what differs first."""
    df = fn(spark, sf_dir)
    kinds = {c: t for c, t, *_ in con.execute(f"DESCRIBE {sql}").fetchall()}
    if {c: KINDS.get(t, t) for c, t in df.dtypes} != kinds:
        return f"types {df.dtypes} / {kinds}"
    names, rows = sql_rows(con, sql)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    mine = normal(df.columns, [tuple(r) for r in df.collect()])
    theirs = normal(names, rows)
    if len(mine) != len(theirs):
        return f"{len(mine)} rows / {len(theirs)}"
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(mine)} rows differ, columns {sorted(names)}: {wrong[0]}"
    return None if mine else "no rows"


def main() -> None:
    import __spark_entry__ as entry
    from millrace.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    spark = local_session("oracle")
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in oracles:
                found = differences(spark, con, sf_dir, fn, oracles[name]) or "same"
            else:
                rows = fn(spark, sf_dir).collect()
                found = f"no SQL, {len(rows)} rows, first {rows[:1]}"
        except Exception as error:  # noqa: BLE001
            found = f"ERROR {type(error).__name__} {str(error)[:600]}"
        print(f"{name:26s} {time.time() - start:6.2f}s {found}", flush=True)


if __name__ == "__main__":
    main()
