"""Side-by-side runs of a query and its SQL."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

DATA = Path("/root/testdata")


def connect(folder: Path) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in sorted(folder.glob("*.parquet")):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value


def same(df, c: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if the rows agree, else what does not."""
    names = sorted(df.columns)
    theirs = c.sql(sql)
    if sorted(theirs.columns) != names:
        return f"columns {names} and {sorted(theirs.columns)}"
    quoted = ", ".join(f'"{n}"' for n in names)
    right = sorted((tuple(map(plain, r)) for r in theirs.query("t", f"SELECT {quoted} FROM t").fetchall()), key=repr)
    left = sorted((tuple(map(plain, r)) for r in df.select(*names).collect()), key=repr)
    if len(left) != len(right):
        return f"{len(left)} and {len(right)} rows; {left[:2]} {right[:2]}"
    odd = [(a, b) for a, b in zip(left, right, strict=True) if a != b]
    return f"{len(odd)} of {len(left)} rows differ, as {odd[:2]}" if odd else ""
