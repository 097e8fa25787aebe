"""Compare a query with its SQL on the same tables, rows in any order."""

import math
import os

import duckdb


def rows_of(frame):
    columns = sorted(frame.columns)
    plain = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) == "NaT" else round(v, 6) if isinstance(v, float) else v
    return columns, sorted((tuple(plain(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False)), key=str)


def differences(spark, query, sql, folder):
    db = duckdb.connect()
    for name in os.listdir(folder):
        path = f"{folder}/{name}"
        db.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    (ours, a), (theirs, b) = rows_of(query(spark, folder).toPandas()), rows_of(db.sql(sql).df())
    assert ours == theirs
    return [(x, y) for x, y in zip(a, b, strict=False) if x != y] or ([] if len(a) == len(b) else [len(a), len(b)])
