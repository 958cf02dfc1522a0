"""Every registered query against its SQL twin in DuckDB, on the smallest tables."""

import math
from concurrent.futures import ThreadPoolExecutor

import duckdb

from lexmill import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(map(plain, v.values()))
    return float(v) if type(v).__name__ == "Decimal" else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr(tuple(plain(r[i]) for i in order)) for r in found)


def test_queries_equal_their_sql(spark, sf_dir):
    queries, sql = registry.queries(), registry.oracle_sql()
    assert len(queries) > 180 and set(sql) <= set(queries)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")

    def ours(name):
        df = queries[name](spark, sf_dir)
        return name, rows(df.columns, [tuple(r) for r in df.collect()])

    with ThreadPoolExecutor(4) as pool:
        got = dict(pool.map(ours, queries))
    bad = []
    for name, text in sql.items():
        q = con.sql(text)
        if got[name] != rows(q.columns, q.fetchall()):
            bad.append(name)
    assert not bad
