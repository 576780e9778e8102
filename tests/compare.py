"""Spark results against DuckDB on the same tables, order aside."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if not isinstance(x, (list, tuple)) and not hasattr(x, "__len__") and pd.isna(x):
        return "~"
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return str(bool(x))
    if isinstance(x, (int, float)) or type(x).__module__ == "numpy":
        return repr(int(x)) if float(x).is_integer() else repr(round(float(x), 9))
    return str(x)


def rows(frame):
    return sorted(tuple(value(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


def assert_same(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
