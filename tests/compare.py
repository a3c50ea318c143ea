"""Compare a Spark result with the second engine's, by value and by type."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if value is None or value != value:
        return None
    return value.item() if hasattr(value, "item") else value


def _rows(table) -> tuple[list[str], list[str], list[tuple]]:
    names = sorted(table.column_names)
    types = [str(table.schema.field(n).type).replace("large_", "") for n in names]
    columns = [table.column(n).to_pylist() for n in names]
    rows = sorted(zip(*columns), key=lambda r: tuple((x is None, str(x)) for x in r))
    return names, types, [tuple(_plain(x) for x in r) for r in rows]


def differences(df, con, sql: str) -> str:
    """Empty when both results agree, else what differs first."""
    ours = _rows(df.toArrow())
    theirs = _rows(con.execute(sql).to_arrow_table())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} / {theirs[0]}"
    if not ours[2] and not theirs[2]:
        return "no rows on either side"
    if ours[1] != theirs[1]:
        return f"types {[(n, a, b) for n, a, b in zip(ours[0], ours[1], theirs[1]) if a != b]}"
    if len(ours[2]) != len(theirs[2]):
        return f"{len(ours[2])} rows / {len(theirs[2])} rows"
    for a, b in zip(ours[2], theirs[2]):
        if a != b:
            return f"{ours[0]}\n ours   {a}\n theirs {b}"
    return ""
