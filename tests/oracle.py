"""Compares a DataFrame with what DuckDB says: names, number of rows, values."""

import os

import duckdb
import numpy as np


def rows(frame):
    names = sorted(frame.columns)
    plain = frame[names].astype(object).where(frame[names].notna(), None).values.tolist()
    kind = lambda v: bool(v) if isinstance(v, (bool, np.bool_)) else int(v) if isinstance(v, (int, np.integer)) else float(v) if isinstance(v, (float, np.floating)) else v
    return names, sorted((tuple(kind(v) for v in r) for r in plain), key=str)


def same(df, sql, sf_dir):
    with duckdb.connect() as db:
        for name in os.listdir(sf_dir):
            db.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
        expected = db.sql(sql).df()
    assert rows(df.toPandas()) == rows(expected)
