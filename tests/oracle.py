"""Comparing a Spark result with DuckDB's."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    pdf = pdf.where(pdf.notna(), None)
    text = lambda v: "NULL" if v is None else repr(round(v, 9)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(text, r)) for r in pdf.itertuples(index=False))


def same(df, con, sql):
    mine, theirs = df.toPandas(), con.sql(sql).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)
