"""Side-by-side comparison of a registered query with its check SQL, as sorted rows."""
from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted((tuple(_cell(row[n]) for n in names) for row in df.collect()), key=repr)


def sql_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    order = sorted(range(len(columns)), key=columns.__getitem__)
    rows = [tuple(_cell(row[i]) for i in order) for row in result.fetchall()]
    return sorted(columns), sorted(rows, key=repr)


def first_difference(left: list[tuple], right: list[tuple]) -> str:
    for a, b in zip(left, right):
        if a != b:
            return f"\n  spark {str(a)[:1500]}\n  sql   {str(b)[:1500]}"
    return "no row differs"
