"""Comparison of a registered query with its DuckDB SQL."""

from __future__ import annotations

from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(table) -> tuple[list[str], list[str]]:
    """Column names and rows of an Arrow table, in an order of their own: nulls stay nulls, integers integers.

    A decimal, which SQL makes of some constants, counts as the double that Spark has.
    """
    columns = sorted(table.column_names)
    return columns, sorted(repr([float(r[c]) if isinstance(r[c], Decimal) else r[c] for c in columns]) for r in table.to_pylist())


def compare(spark, data: str, query, sql: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    assert rows(query(spark, data).toArrow()) == rows(con.sql(sql).arrow().read_all())
