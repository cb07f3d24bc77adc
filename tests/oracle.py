"""A query's rows against its DuckDB SQL's."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(plain(y) for y in x)
    if x is None or x is pd.NA or (isinstance(x, float) and np.isnan(x)):
        return None
    if isinstance(x, (float, np.floating)):
        return round(float(x), 9)
    return x


def rows(found):
    return sorted((tuple(plain(v) for v in r) for r in found), key=lambda r: tuple((v is None, str(v)) for v in r))


def agree(spark, query, sql, folder):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = query(spark, folder)
    other = con.sql(sql)
    assert sorted(df.columns) == sorted(other.columns)
    at = [other.columns.index(c) for c in df.columns]
    mine, theirs = rows(df.collect()), rows(tuple(r[i] for i in at) for r in other.fetchall())
    assert len(mine) == len(theirs)
    assert mine == theirs
