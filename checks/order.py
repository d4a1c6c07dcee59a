"""Order-dependent operators and run-level counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.operators import prep, windows
from runlens.operators.prep import KEYS

from .views import runs, typed_series, user_series, with_views

K = '"faultNumber", "simulationRun"'
OVER = f"OVER (PARTITION BY {K} ORDER BY sample)"


def w1_order_run(spark, sf):
    df = windows.with_position(runs(spark, sf).drop("t"), block=F.expr("sample div 64"))
    return df.select(*KEYS, "sample", "t")


def w2_head_per_run(spark, sf):
    df = windows.head_per_run(runs(spark, sf), 120, 100)
    return df.groupBy(*KEYS).agg(F.count("*").alias("n"), F.max("sample").alias("last"))


def w3_fixed_length(spark, sf):
    df = windows.fixed_length(runs(spark, sf), 100)
    return df.groupBy(*KEYS).agg(F.count("*").alias("n"), F.round(F.sum(F.col("x")[0]), 2).alias("total"))


def w4_min_samples(spark, sf):
    _, table = windows.min_samples(typed_series(spark, sf), 12)
    return table.select(*KEYS, "n", "status")


def w5_lag_stack(spark, sf):
    df = windows.lag_stack(runs(spark, sf), 2, block=64)
    return df.select(*KEYS, "sample", *[F.col("x")[i].alias(f"z{i:02d}") for i in range(12)])


def w6_past_future_stack(spark, sf):
    df = windows.past_future_stack(runs(spark, sf, two=True), 2, 2, block=64)
    return df.select(*KEYS, "sample", *[F.round(F.col("p")[i], 6).alias(f"p{i}") for i in range(4)],
                     *[F.round(F.col("f")[i], 6).alias(f"f{i}") for i in range(4)])


def w7_derivative(spark, sf):
    df = windows.derivative(runs(spark, sf), block=64)
    return df.select(*KEYS, "sample", *[F.round(F.col("dx")[i], 6).alias(f"d{i}") for i in range(4)])


def w8_reset_time(spark, sf):
    df = prep.drop_pre_fault(runs(spark, sf).drop("t"), 21, uniform=True)
    return windows.with_position(df).select(*KEYS, "sample", "t")


def a12_run_length_audit(spark, sf):
    lengths = windows.run_table(runs(spark, sf))
    return lengths.groupBy("faultNumber").agg(
        F.count("*").alias("runs"), F.countDistinct("n").alias("lengths"), F.min("n").alias("shortest"),
        F.max("n").alias("longest"), F.every("gap_free").alias("gap_free"),
        (F.countDistinct("n") > 1).alias("warn"))


def w1_user_series(spark, sf):
    return user_series(spark, sf).select("simulationRun", "t", F.col("x")[0].alias("v"))


_all = "x0 x1 x2 x3".split()
QUERIES = {
    "w1_order_run": (w1_order_run, with_views("runs4", f"SELECT {K}, sample, row_number() {OVER} - 1 AS t FROM runs4")),
    "w1_user_series": (w1_user_series, with_views("series1", 'SELECT "simulationRun", CAST(sample AS BIGINT) - 1 AS t, v FROM series1')),
    "w2_head_per_run": (w2_head_per_run, with_views("runs4", f"""
SELECT {K}, count(*) AS n, max(sample) AS last FROM runs4 WHERE sample <= CASE WHEN "faultNumber"=0 THEN 120 ELSE 100 END GROUP BY 1,2""")),
    "w3_fixed_length": (w3_fixed_length, with_views("runs4", f"""
SELECT {K}, count(*) AS n, round(sum(x0),2) AS total FROM runs4 WHERE sample <= 100 GROUP BY 1,2""")),
    "w4_min_samples": (w4_min_samples, with_views("series1c", f"""
SELECT {K}, count(*) AS n, CASE WHEN count(*) < 12 THEN 'skipped' ELSE 'ok' END AS status FROM series1c GROUP BY 1,2""")),
    "w5_lag_stack": (w5_lag_stack, with_views("runs4", f"""
WITH s AS (SELECT {K}, sample, {", ".join(f"lag(x{i},{l}) {OVER} AS z{l*4+i:02d}" for l in range(3) for i in range(4))} FROM runs4)
SELECT * FROM s WHERE sample > 2""")),
    "w6_past_future_stack": (w6_past_future_stack, with_views("runs2", f"""
WITH s AS (SELECT {K}, sample, {", ".join(f"round(lag(a,{j}) {OVER},6) AS p{2*j-2}, round(lag(b,{j}) {OVER},6) AS p{2*j-1}" for j in (1, 2))},
 round(a,6) AS f0, round(b,6) AS f1, round(lead(a) {OVER},6) AS f2, round(lead(b) {OVER},6) AS f3 FROM runs2)
SELECT * FROM s WHERE p2 IS NOT NULL AND f2 IS NOT NULL""")),
    "w7_derivative": (w7_derivative, with_views("runs4", f"""
SELECT {K}, sample, {", ".join(f"round((coalesce(lead(x{i}) {OVER}, x{i}) - coalesce(lag(x{i}) {OVER}, x{i})) / (CASE WHEN lead(x{i}) {OVER} IS NULL OR lag(x{i}) {OVER} IS NULL THEN 1.0 ELSE 2.0 END),6) AS d{i}" for i in range(4))} FROM runs4""")),
    "w8_reset_time": (w8_reset_time, with_views("runs4", f"""
SELECT {K}, sample, row_number() {OVER} - 1 AS t FROM runs4 WHERE sample >= 21""")),
    "a12_run_length_audit": (a12_run_length_audit, with_views("runs4", f"""
WITH l AS (SELECT {K}, count(*) AS n FROM runs4 GROUP BY 1,2)
SELECT "faultNumber", count(*) AS runs, count(DISTINCT n) AS lengths, min(n) AS shortest, max(n) AS longest,
 true AS gap_free, count(DISTINCT n) > 1 AS warn FROM l GROUP BY 1""")),
}
