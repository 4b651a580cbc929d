"""Compares a registered query with its SQL on the same tables."""

import glob
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    return order, sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


def compare(spark, con, query, sql, sf_dir):
    got = query(spark, sf_dir)
    relation = con.sql(sql)
    assert rows_of(got.columns, got.collect()) == rows_of(relation.columns, relation.fetchall())
