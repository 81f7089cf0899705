"""Compares a registered query with its oracle SQL, the way the driver does."""

import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}"
    if isinstance(x, (list, tuple)):
        return tuple(_plain(v) for v in x)
    return x if x is None or isinstance(x, (bool, str)) else str(x) if not isinstance(x, int) else x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in data)


def differences(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got_names, got = rows(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    want_names, want = rows([d[0] for d in res.description], res.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if got != want:
        return f"rows {sum(got.values())} != {sum(want.values())}: only here {list((got - want).items())[:3]}, only there {list((want - got).items())[:3]}"
    return None
