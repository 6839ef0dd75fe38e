"""Comparison of a query with its DuckDB SQL."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(float(v), 9) if isinstance(v, float) else v
    return [columns[i] for i in order], sorted(repr(tuple(plain(r[i]) for i in order)) for r in records)


def same(spark, query, sql, sf_dir):
    frame = query(spark, sf_dir)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(sql)
    expected = rows([d[0] for d in found.description], found.fetchall())
    got = rows(frame.columns, [tuple(r) for r in frame.collect()])
    assert got[0] == expected[0]
    assert got[1] == expected[1]
