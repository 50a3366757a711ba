"""Compare a query with its SQL: same columns, same rows in any order."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v: object) -> object:
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return str(v) if not isinstance(v, (int, str, bool, type(None))) else v


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    order = sorted(names)
    want = Counter(tuple(_plain(r[names.index(c)]) for c in order) for r in result.fetchall())
    got = Counter(tuple(_plain(r[c]) for c in order) for r in df.select(*[f"`{c}`" for c in order]).collect())
    return [] if got == want else [f"only here {list((got - want).items())[:3]}", f"only in SQL {list((want - got).items())[:3]}"]
