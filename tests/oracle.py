"""Runs a query beside its DuckDB SQL and compares rows without order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fix = lambda v: round(float(v), 4) if isinstance(v, float) or type(v).__name__ == "Decimal" else v.isoformat() if hasattr(v, "isoformat") else v
    return [columns[i] for i in order], sorted((tuple(fix(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    return got, canonical([c[0] for c in res.description], res.fetchall())
