"""Rows of Spark and of DuckDB in one form."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


def duck(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return connection


def rows_of(df):
    names = sorted(df.columns)
    return sorted((tuple(plain(x) for x in r) for r in df.select(*names).collect()), key=repr)


def rows_of_sql(connection, sql):
    result = connection.execute(sql)
    names = [x[0] for x in result.description]
    order = [names.index(n) for n in sorted(names)]
    return sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=repr)
