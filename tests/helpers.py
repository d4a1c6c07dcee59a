"""Small hand-made runs."""

import duckdb
import numpy as np
import pandas as pd

SCHEMA = "faultNumber int, simulationRun int, sample int, t bigint, x array<double>"


def make_runs(spark, lengths: dict, width: int = 2, seed: int = 0):
    """lengths: {(fault, run): samples}; returns (DataFrame, {key: matrix}). Rows are shuffled."""
    rng = np.random.RandomState(seed)
    rows, data = [], {}
    for (fault, run), n in lengths.items():
        x = np.cumsum(rng.normal(size=(n, width)), axis=0) + rng.normal(size=(n, width)) + 5.0
        x = np.round(x, 3)
        data[fault, run] = x
        rows += [(fault, run, i + 1, i, [float(v) for v in x[i]]) for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA), data


def by_run(df, column):
    """{(fault, run): matrix ordered by t} of an array column."""
    pdf = df.select("faultNumber", "simulationRun", "t", column).toPandas().sort_values("t")
    return {k: np.stack(g[column].to_numpy()) for k, g in pdf.groupby(["faultNumber", "simulationRun"])}


def frame(df) -> pd.DataFrame:
    return df.toPandas()


def given_tables(folder, runs: dict, users: dict) -> str:
    """lineitem with so many rows per (return flag, supplier) and events with so many rows per user, made for a test."""
    con = duckdb.connect()
    items = ", ".join(f"('{flag}', {supplier}, {n})" for (flag, supplier), n in runs.items())
    con.sql(f"""COPY (SELECT CAST(hash(s, i) % 100000 AS BIGINT) AS l_orderkey, CAST(i AS BIGINT) AS l_partkey, CAST(s AS BIGINT) AS l_suppkey,
 CAST(i % 7 AS INTEGER) AS l_linenumber, CAST(1 + hash(i, s) % 50 AS DOUBLE) AS l_quantity, 900.0 + CAST(hash(i, f) % 9000 AS DOUBLE) AS l_extendedprice,
 CAST(hash(s, i, 1) % 11 AS DOUBLE) / 100 AS l_discount, CAST(hash(s, i, 2) % 9 AS DOUBLE) / 100 AS l_tax, f AS l_returnflag,
 TIMESTAMP '1995-01-02' + to_days(CAST(hash(i, f, s) % 2400 AS INTEGER)) AS l_shipdate
 FROM (VALUES {items}) v(f, s, n), range(n) t(i)) TO '{folder}/lineitem.parquet'""")
    seen = ", ".join(f"({user}, {n})" for user, n in users.items())
    con.sql(f"""COPY (SELECT CAST(u * 1000 + i AS BIGINT) AS event_id, TIMESTAMP '2024-01-01' + to_seconds(CAST(hash(u, i) % 2500000 AS INTEGER)) AS ts,
 CAST(u AS BIGINT) AS user_id, ['click', 'error', 'purchase', 'signup', 'view'][1 + i % 5] AS event_type, CAST(hash(i, u) % 1000 AS DOUBLE) / 8 AS value
 FROM (VALUES {seen}) v(u, n), range(n) t(i)) TO '{folder}/events.parquet'""")
    return str(folder)


def by_sql(folder: str, sql: str, tables) -> list:
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return sorted(con.sql(sql).fetchall())
