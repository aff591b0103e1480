"""Compares a query with its SQL, as sorted rows with columns by name."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, bool):
        return value
    return round(float(value), 6) if isinstance(value, int | float) or type(value).__name__ == "Decimal" else str(value)


def compare(spark, query, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    found = query(spark, sf_dir)
    expected = con.execute(sql)
    names = [d[0] for d in expected.description]
    assert sorted(names) == sorted(found.columns)
    order = sorted(names)
    rows = lambda got, at: sorted((tuple(plain(r[k]) for k in at) for r in got), key=repr)
    assert rows(found.select(*order).collect(), range(len(order))) == rows(expected.fetchall(), [names.index(n) for n in order])
