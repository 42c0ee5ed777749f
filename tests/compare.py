"""Query rows against SQL rows, as the driver compares them: columns by name, rows as a multiset."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings blocks chunks glossary jobs "
          "usage_records reading_labels benchmark size_specs").split()  # fmt: skip


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if Path(f"{folder}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if hasattr(x, "tzinfo") and hasattr(x, "replace"):
        return x.replace(tzinfo=None)
    if isinstance(x, (list, tuple)):
        return tuple(map(value, x))
    return x


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(value(row[i]) for i in order) for row in rows)


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """What differs, in words; empty if nothing does."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns: {sorted(df.columns)} and {sorted(names)}"
    want = rows_of(names, result.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if got == want:
        return ""
    return f"{sum(got.values())} rows and {sum(want.values())}; only in one {list((got - want).items())[:2]}; only in the other {list((want - got).items())[:2]}"
