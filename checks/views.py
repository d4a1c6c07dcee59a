"""The given tables seen as runs, series and feature matrices (Spark side and SQL side)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.operators.windows import with_position

RUN_CHANNELS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Days that are numbered together. The numbers of rows per run and block are brought together before samples get their positions:
#: with one day a block, nearly every sample of a run of some hundred is a block of its own.
DAYS = 128


def run_values(spark, sf, two=False) -> DataFrame:
    """The samples of ``runs`` before they are numbered: class, run, x and the columns of their order."""
    li = table(spark, sf, "lineitem")
    fault = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    x = ([F.col("l_quantity") / 50, F.col("l_discount") * 10] if two
         else [F.col(c) for c in RUN_CHANNELS])
    return li.select(fault.cast("int").alias("faultNumber"), F.col("l_suppkey").cast("int").alias("simulationRun"),
                     "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
                     F.array(*x).alias("x"))


def runs(spark, sf, two=False) -> DataFrame:
    """lineitem as runs: class = return flag, run = supplier, order = ship date and tie-breaks.

    Columns faultNumber, simulationRun, sample, x; ``two`` keeps two channels of similar scale.
    """
    rows = with_position(run_values(spark, sf, two), order=["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"],
                         block=F.expr(f"floor(datediff(l_shipdate, '1990-01-01') / {DAYS})"))
    return rows.select("faultNumber", "simulationRun", (F.col("t") + 1).cast("int").alias("sample"), "t", "x")


def user_series(spark, sf) -> DataFrame:
    """events as one-channel runs: run = user, order = (ts, event_id)."""
    ev = table(spark, sf, "events").select(
        F.lit(0).alias("faultNumber"), F.col("user_id").cast("int").alias("simulationRun"), "ts", "event_id",
        F.array("value").alias("x"))
    rows = with_position(ev, order=["ts", "event_id"], block=F.expr("floor(unix_timestamp(ts) / (4 * 86400))"))
    return rows.select("faultNumber", "simulationRun", (F.col("t") + 1).cast("int").alias("sample"), "t", "x")


def long_series(spark, sf) -> DataFrame:
    """lineitem as three long one-channel runs, one per return flag: many blocks each."""
    li = table(spark, sf, "lineitem")
    code = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    rows = li.select(F.lit(0).alias("faultNumber"), code.cast("int").alias("simulationRun"), *order,
                     F.array(F.col("l_extendedprice") / 1000).alias("x"))
    rows = with_position(rows, order=order, block=F.datediff("l_shipdate", F.lit("1990-01-01")))
    return rows.select("faultNumber", "simulationRun", (F.col("t") + 1).cast("int").alias("sample"), "t", "x")


EVENT_CLASS = ["click", "error", "purchase", "signup", "view"]


def typed_series(spark, sf) -> DataFrame:
    """events as short one-channel runs: class = event type, run = user."""
    code = F.array_position(F.lit(EVENT_CLASS), F.col("event_type")) - 1
    ev = table(spark, sf, "events").select(
        code.cast("int").alias("faultNumber"), F.col("user_id").cast("int").alias("simulationRun"), "ts", "event_id",
        F.array("value").alias("x"))
    rows = with_position(ev, order=["ts", "event_id"], block=F.expr("floor(unix_timestamp(ts) / (4 * 86400))"))
    return rows.select("faultNumber", "simulationRun", (F.col("t") + 1).cast("int").alias("sample"), "t", "x")


def vectors(spark, sf) -> DataFrame:
    """embeddings as a feature matrix: run_id, label, x (64 doubles), split (every 5th run is test)."""
    em = table(spark, sf, "embeddings")
    return em.select(F.col("vec_id").alias("run_id"), "label", F.col("embedding").cast("array<double>").alias("x"),
                     F.when(F.col("vec_id") % 5 == 0, "test").otherwise("train").alias("split"))


def feature_long(spark, sf) -> DataFrame:
    """The same matrix in long form: run_id, label, split, feature, value."""
    return vectors(spark, sf).select("run_id", "label", "split", F.posexplode("x").alias("feature", "value")) \
        .withColumn("feature", F.format_string("f%02d", "feature"))


def with_gaps(long: DataFrame) -> DataFrame:
    """The long matrix with some values made missing or infinite, as feature formulas can leave them."""
    k = F.col("run_id") * 64 + F.substring("feature", 2, 2).cast("int")
    return long.withColumn("value", F.when(k % 97 == 0, float("nan")).when(k % 101 == 0, float("inf"))
                           .when(k % 103 == 0, float("-inf")).when(k % 107 == 0, None).otherwise(F.col("value")))


SQL = {
    "gaps": """gaps AS (SELECT run_id, label, split, feature, CASE WHEN k % 97 = 0 THEN CAST('nan' AS DOUBLE)
  WHEN k % 101 = 0 THEN CAST('inf' AS DOUBLE) WHEN k % 103 = 0 THEN CAST('-inf' AS DOUBLE) WHEN k % 107 = 0 THEN NULL
  ELSE value END AS value FROM (SELECT *, run_id*64 + CAST(substr(feature,2,2) AS INTEGER) AS k FROM feat))""",
    "runs4": """runs4 AS (SELECT CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS "faultNumber",
  CAST(l_suppkey AS INTEGER) AS "simulationRun",
  CAST(row_number() OVER (PARTITION BY l_returnflag, l_suppkey
       ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS INTEGER) AS sample,
  l_quantity AS x0, l_extendedprice AS x1, l_discount AS x2, l_tax AS x3 FROM lineitem)""",
    "runs2": """runs2 AS (SELECT "faultNumber", "simulationRun", sample, x0/50 AS a, x2*10 AS b FROM runs4)""",
    "long4": """long4 AS (SELECT "faultNumber","simulationRun",sample,0 AS channel,x0 AS v FROM runs4
  UNION ALL SELECT "faultNumber","simulationRun",sample,1,x1 FROM runs4
  UNION ALL SELECT "faultNumber","simulationRun",sample,2,x2 FROM runs4
  UNION ALL SELECT "faultNumber","simulationRun",sample,3,x3 FROM runs4)""",
    "series1": """series1 AS (SELECT 0 AS "faultNumber", CAST(user_id AS INTEGER) AS "simulationRun",
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS sample, value AS v FROM events)""",
    "serieslong": """serieslong AS (SELECT 0 AS "faultNumber", CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS "simulationRun",
  CAST(row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS sample,
  l_extendedprice/1000 AS v FROM lineitem)""",
    "series1c": """series1c AS (SELECT CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2
  WHEN 'signup' THEN 3 ELSE 4 END AS "faultNumber", CAST(user_id AS INTEGER) AS "simulationRun",
  CAST(row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS INTEGER) AS sample,
  value AS v FROM events)""",
    "vec": """vec AS (SELECT vec_id AS run_id, label, embedding, CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END AS split
  FROM embeddings)""",
    "feat": """feat AS (SELECT run_id, label, split, 'f' || lpad(CAST(i AS VARCHAR), 2, '0') AS feature,
  CAST(embedding[i + 1] AS DOUBLE) AS value FROM vec, (SELECT unnest(range(64)) AS i))""",
}
NEEDS = {"runs2": ["runs4"], "long4": ["runs4"], "feat": ["vec"], "gaps": ["feat"]}


def with_views(names: str, body: str) -> str:
    """Prefix a statement with the named view definitions it uses."""
    order: list = []

    def add(n):
        for m in NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(SQL[n] for n in order) + ",\n" + body[5:]
    return "WITH " + ",\n".join(SQL[n] for n in order) + "\n" + body


def rnd(column, digits: int = 6):
    """Rounding whose ties do not depend on the last bit, so both engines agree."""
    c = F.col(column) if isinstance(column, str) else column
    return (F.floor(c * F.lit(10.0 ** digits) + F.lit(0.501)).cast("double") / F.lit(10.0 ** digits)) + F.lit(0.0)


def q(expression: str, digits: int = 6) -> str:
    """The same rounding as SQL text."""
    return f"(floor(({expression}) * 1e{digits} + 0.501) / 1e{digits} + 0.0)"
