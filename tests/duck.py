"""Compare a registered query with its SQL on the same tables."""

from __future__ import annotations

import os

import duckdb

SF = "/root/testdata/sf0.001"


def connection(sf_dir: str = SF):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
    return con


def assert_same(df, sql: str, con) -> None:
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    want = sorted(str(tuple(row[i] for i in order)) for row in found.fetchall())
    got = sorted(str(tuple(row[c] for c in sorted(names))) for row in df.collect())
    assert got == want, (len(got), len(want), [x for x in got if x not in set(want)][:3], [x for x in want if x not in set(got)][:3])
