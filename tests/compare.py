"""Compare a query with its SQL in DuckDB: column names, rows and values, in any order."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float | decimal.Decimal | int):
        f = float(v)
        return "nan" if math.isnan(f) else str(int(f)) if f == int(f) else repr(f)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both agree, else what differs."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    mine = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    at = [names.index(c) for c in order]
    wanted = sorted(tuple(plain(r[i]) for i in at) for r in theirs)
    if mine == wanted:
        return "" if mine else "both empty"
    if len(mine) != len(wanted):
        head = f"{len(mine)} rows and {len(wanted)}; "
    else:
        head = f"{sum(a != b for a, b in zip(mine, wanted, strict=True))} of {len(mine)} rows differ; "
    left, right = [x for x in mine if x not in set(wanted)][:3], [x for x in wanted if x not in set(mine)][:3]
    return f"{head}{order}: {left} and {right}"
