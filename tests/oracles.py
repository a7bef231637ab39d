"""Queries compared with the SQL that DuckDB answers on the same tables."""

from __future__ import annotations

import decimal
from pathlib import Path

DATA = Path("/root/testdata/sf0.001")


def plain(value):
    """A value as both engines can give it."""
    if isinstance(value, (float, decimal.Decimal)):
        return None if value != value else round(float(value), 9)
    if hasattr(value, "asDict"):
        return tuple(map(plain, value))
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return bytes(value) if isinstance(value, bytearray) else value


def rows_of_both(spark, query, sql: str) -> tuple[list, list]:
    """Sorted rows of the query and of the SQL, columns by name, which must agree."""
    import duckdb

    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = query(spark, str(DATA))
    names = sorted(df.columns)
    relation = con.sql(sql)
    assert sorted(relation.columns) == names
    quoted = ", ".join(f'"{n}"' for n in names)
    want = con.sql(f"SELECT {quoted} FROM ({sql})").fetchall()
    got = df.select([f"`{n}`" for n in names]).collect()
    return tuple(sorted(repr(tuple(map(plain, r))) for r in rows) for rows in (got, want))
