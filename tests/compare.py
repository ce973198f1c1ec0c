"""Runs a query and its SQL side by side, as the driver does."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(tuple, frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()), key=repr)


def differ(spark, f, sql: str, sf_dir: str) -> str:
    got = f(spark, sf_dir)
    want = duckdb.connect()
    for t in TABLES:
        want.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    a, b = rows_of(got.toPandas()), rows_of(want.execute(sql).df())
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"{len(a[1])} and {len(b[1])} rows"
    wrong = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
    return f"{len(wrong)} rows differ, as {wrong[0]}" if wrong else ""
