"""Holds a query's rows against those of its SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF_DIR = "/root/testdata/sf0.001"


def shown(x: object) -> str:
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, float):
        return repr(float(f"{x:.10g}"))
    return str(x)


def rows(columns: list[str], found: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(shown(r[i]) for i in order) for r in found)


def same(spark, query, sql: str, sf_dir: str = SF_DIR) -> None:
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = query(spark, sf_dir)
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    got, expected = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, want.fetchall())
    assert len(got) == len(expected)
    assert got == expected
