"""Side-by-side comparison of a query with its DuckDB SQL."""

from __future__ import annotations

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir, f"{name}.parquet")
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(repr(r[i]) for i in order) for r in rows)


def assert_same(spark, con, name, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == want[0], (name, got[0], want[0])
    assert got[1] == want[1], (name, len(got[1]), len(want[1]), [x for x in got[1] if x not in want[1]][:3], [x for x in want[1] if x not in got[1]][:3])
