"""Rows of a query and of its SQL, for comparison."""

import math
import os

import duckdb


def rounded(rows):
    out = []
    for row in rows:
        out.append(tuple(round(v, 9) if isinstance(v, float) and math.isfinite(v) else v for v in row))
    return sorted(out, key=repr)


def assert_same(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{sf_dir}/{name}'")
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(columns).collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()]
    assert rounded(got) == rounded(want)
