"""Comparison of a query with its DuckDB SQL."""

import math
import os

import duckdb

SF = "/root/testdata/sf0.01"


def connect(sf_dir: str = SF):
    db = duckdb.connect()
    for f in os.listdir(sf_dir):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return db


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        return v.replace(tzinfo=None)
    return v


def rows(names, table):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in table), key=repr)


def compare(spark, query, sql, sf_dir: str = SF):
    got = query(spark, sf_dir)
    ran = connect(sf_dir).execute(sql)
    names = [c[0] for c in ran.description]
    assert sorted(got.columns) == sorted(names)
    mine, theirs = rows(got.columns, [tuple(r) for r in got.collect()]), rows(names, ran.fetchall())
    assert len(mine) == len(theirs)
    assert mine == theirs
    return len(mine)
