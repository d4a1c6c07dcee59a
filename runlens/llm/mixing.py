"""Mixing sources to target weights: tokens per source, repetition rates, floor(rate) copies plus one Bernoulli copy.

Sources share 100 % of all tokens by weight; none may exceed `most` times its own size, and the excess is reshared by weight
among the others until none is above. In closed form (water filling): with the sources in the order of cap / weight, those
before the first one whose fair share fits are capped, the rest divide what is left. The aggregation is one row per
source, written and read back; everything that grows with the documents is one map-side aggregation and one join with
that table. Spark broadcasts the table only if its measured file size allows, else it shuffles the narrow side and splits
a hot source. Ranking the sources is one window over that table (a catalogue: one row per source, spilled if large).

A document of a source with rate r is emitted floor(r) times, and once more if a uniform number in [0, 1) from the
MD5 of seed and id is below r - floor(r): the draw depends on nothing else, so reruns and recomputed tasks agree.

Defined cases: null text has size 0; a null source is a source of its own, last in the order; a source without tokens has
target 0 and its documents are taken 0 times; rows repeated with one id share one draw; a null id is drawn as ''; an
empty table gives an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runlens.llm.common import stored, table, word_count

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 17


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """From (__source, __size) per document: one row per source with __total (tokens) and __target.

    Weights repeat over the sources in code-point order, null last."""
    per = sizes.groupBy("__source").agg(F.sum("__size").alias("__total"))
    ranked = per.withColumn("__at", F.row_number().over(W.orderBy(F.col("__source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]),
                          (F.col("__at") % len(weights) + 1).cast("int")).cast("long")
    order = W.orderBy(F.col("__total") / F.col("__weight"), "__at")
    before, here_on = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    everywhere = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    cap = F.col("__total") * most
    left = F.sum("__total").over(everywhere) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    steps = (ranked.withColumn("__weight", weight)
             .withColumn("__left", left).withColumn("__open", F.sum("__weight").over(here_on))
             .withColumn("__fits", F.col("__weight") * F.col("__left") <= cap * F.col("__open")))
    steps = steps.withColumn("__k", F.row_number().over(order))
    first = F.min(F.when(F.col("__fits"), F.struct("__k", "__left", "__open"))).over(everywhere)
    share = F.col("__weight") * F.col("__first.__left") / F.col("__first.__open")
    return (steps.withColumn("__first", first)
            .select("__source", "__total",
                    F.when(F.col("__k") < F.col("__first.__k"), cap.cast("double")).otherwise(share).alias("__target")))


def draw(ident: Column, seed: int = SEED) -> Column:
    """Uniform number in [0, 1): the first 52 bits of the MD5 of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          weights: tuple = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """`docs` with __size, __total, __target and __copies."""
    size = word_count(F.col(text_col))
    plan = stored(targets(docs.select(F.col(source_col).alias("__source"), size.alias("__size")), weights, most),
                  "mix-targets").withColumnRenamed("__source", "__plan_source")
    rows = docs.withColumn("__size", size)
    rate = F.when(F.col("__total") > 0, F.col("__target") / F.col("__total")).otherwise(0.0)
    extra = (draw(F.col(id_col), seed) < F.col("__rate") - F.floor("__rate")).cast("int")
    return (rows.join(plan, rows[source_col].eqNullSafe(plan["__plan_source"])).drop("__plan_source")
            .withColumn("__rate", rate)
            .withColumn("__copies", F.floor("__rate").cast("int") + extra).drop("__rate"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mixture: the rows of `docs`, each as often as its source's rate says."""
    columns = docs.columns
    rows = mixed(docs, id_col, text_col, source_col, weights, most, seed).where("__copies > 0")
    return rows.select(*columns, F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__nth")).select(columns)


def op6_mix_sources(spark, sf_dir):
    rows = mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return rows.select("doc_id", F.col("__size").alias("size"), F.col("__total").alias("source_size"),
                       F.col("__target").alias("target"), (F.col("__copies") * F.col("__size")).alias("taken"))


SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size
  from documents),
s as (select source, sum(size)::bigint as total from d group by source),
r as (select *, (row_number() over (order by source nulls last) - 1)::bigint as nth from s),
w as (select *, (case nth % 3 when 0 then 5 when 1 then 2 else 1 end)::bigint as weight from r),
c as (select *, row_number() over o as k,
        sum(total) over () - coalesce(sum(3 * total) over (o rows between unbounded preceding and 1 preceding), 0) as l,
        sum(weight) over (o rows between current row and unbounded following) as open
      from w window o as (order by total::double / weight::double, nth)),
f as (select * from c where weight * l <= 3 * total * open order by k limit 1),
t as (select c.source, c.total, case when c.k < f.k then (3 * c.total)::double
        else (c.weight * f.l)::double / f.open::double end as target from c, f),
j as (select d.doc_id, d.size, t.total, t.target, case when t.total > 0 then t.target / t.total else 0 end as rate,
        ('0x' || substr(md5('17:' || coalesce(d.doc_id::varchar, '')), 1, 13))::bigint::double / 4503599627370496.0 as u
      from d join t on d.source is not distinct from t.source)
select doc_id, size, total as source_size, target,
       ((floor(rate)::bigint + case when u < rate - floor(rate) then 1 else 0 end) * size)::bigint as taken
from j
"""

QUERIES = {"op6_mix_sources": (op6_mix_sources, SQL)}
