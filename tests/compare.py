"""Run registered queries next to their DuckDB oracles."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return int(value) if value == int(value) else value
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(df, con, sql):
    """None when equal, else a short account."""
    got_cols = df.columns
    got = rows_of(got_cols, df.collect())
    rel = con.sql(sql)
    want_cols = rel.columns
    want = rows_of(want_cols, rel.fetchall())
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} vs {sorted(want_cols)}"
    if got == want:
        return None
    only_got = [r for r in got if r not in set(want)][:3] if len(got) < 400000 else []
    only_want = [r for r in want if r not in set(got)][:3] if len(want) < 400000 else []
    return f"{sorted(got_cols)} rows {len(got)} vs {len(want)}; only spark {only_got}; only oracle {only_want}"
