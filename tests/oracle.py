"""Run a query in Spark and its SQL in DuckDB over the same tables, and hold the results against each other."""

from __future__ import annotations

from pathlib import Path

import duckdb


def duck(sf_dir: str, sql: str):
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con.execute(sql).to_arrow_table()


def plain(table) -> tuple[list[str], list[tuple]]:
    """Columns by name, rows sorted."""
    names = sorted(table.column_names)
    rows = [tuple(x[n] for n in names) for x in table.select(names).to_pylist()]
    return names, sorted(rows, key=repr)


def kinds(table) -> dict[str, str]:
    return {f.name: str(f.type).replace("large_", "") for f in table.schema}


def compare(query_rows, sql: str, sf_dir: str) -> str:
    """What differs, or an empty string."""
    mine, theirs = query_rows.toArrow(), duck(sf_dir, sql)
    if kinds(mine) != kinds(theirs):
        return f"schema {kinds(mine)} against {kinds(theirs)}"
    (_, a), (_, b) = plain(mine), plain(theirs)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(wrong)} of {len(a)} rows differ, first {wrong[0]}" if wrong else ""
