"""Compare a registered query with its DuckDB SQL, as bags of rows."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6))
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def assert_matches(spark, run, sql: str, sf_dir: str) -> None:
    got = run(spark, sf_dir)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    con.execute("SET TimeZone = 'UTC'")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    mine, theirs = rows_of(got.columns, got.collect()), rows_of(names, want.fetchall())
    assert len(mine) == len(theirs)
    assert mine == theirs
