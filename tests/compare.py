"""Compare a registered query with its SQL in DuckDB."""

import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(value):
    if isinstance(value, decimal.Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, float):
        return "nan" if value != value else round(value, 6)
    return value


def database(folder):
    con = duckdb.connect()
    for name in TABLES.split():
        path = f"{folder}/{name}.parquet"
        con.sql(f"create view {name} as select * from read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


def assert_equal(spark, query, oracle, folder):
    found = query(spark, folder)
    own = rows_of(found.columns, found.collect())
    other = database(folder).sql(oracle)
    assert sorted(found.columns) == sorted(other.columns)
    assert own == rows_of(other.columns, other.fetchall())
    return own
