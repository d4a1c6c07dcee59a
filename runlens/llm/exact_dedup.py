"""Exact deduplication by skew-safe combining: local copies, salted digest groups, then one winner per content.

Two texts are equal when they are identical after deleting the six ASCII white-space characters. Every stage groups by the
digest *and* the whole normalised text, so equality is decided on content, never on a digest alone:

1. the map side of the first aggregation merges the copies that one task has read;
2. its reduce side merges groups of (salt, digest, text), so a text that makes up a third of all rows is
   spread over `salts` tasks;
3. the second aggregation merges at most `salts` winners per original length and text.

Of equal texts the row with the most code points stays, then the one with the smallest id. Both are numbers, hence
plain hash-aggregation buffers: `rank = n_chars * 2^64 - id` is largest for the winner and gives its id back.

Defined cases: a null text counts as empty; empty and white-space-only texts form one group; a null id loses
against any other (a group of null ids only has `keep_id` null and keeps one row); rows repeated with the same id and
equal text are members each, and exactly one of them is kept; an empty table gives an empty result; columns
of the input other than id and text are not read (`deduplicate` passes them through, whatever their names).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import SPACE, if_small, stored, table

WIDE = "decimal(38,0)"
STEP = "18446744073709551616"  # 2^64


def normalised(df: DataFrame, text: str) -> DataFrame:
    """Add __norm, __sha, __check and __n (code points of the original)."""
    raw = F.coalesce(F.col(text), F.lit(""))
    return (df.withColumn("__norm", F.regexp_replace(raw, SPACE, ""))
            .withColumn("__n", F.char_length(raw).cast("long"))
            .withColumn("__sha", F.sha2(F.col("__norm").cast("binary"), 256))
            .withColumn("__check", F.xxhash64("__norm")))


def winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """One row per different content: __sha, __check, keep_id, group_size."""
    wide_id = F.coalesce(F.col("__first").cast(WIDE), F.expr(f"cast('{STEP}' as {WIDE}) / 2").cast(WIDE))
    rows = normalised(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), "__text")
    salted = (rows.withColumn("__salt", F.pmod(F.xxhash64("__id"), F.lit(salts)).cast("int"))
              .groupBy("__salt", "__sha", "__check", "__norm", "__n")
              .agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__rows")))
    rank = F.col("__n").cast("decimal(18,0)") * F.expr(f"cast('{STEP}' as decimal(20,0))") - wide_id
    return (salted.withColumn("__rank", rank.cast(WIDE))
            .groupBy("__sha", "__check", "__norm")
            .agg(F.max("__n").alias("__n"), F.max("__rank").alias("__rank"), F.sum("__rows").alias("group_size"),
                 F.count("__first").alias("__named"))
            .select("__sha", "__check", "group_size",
                    F.expr(f"cast(__n * cast('{STEP}' as decimal(20,0)) - __rank as {WIDE})").alias("__wide"))
            .select("__sha", "__check", "group_size",
                    F.expr(f"case when __wide < cast('{STEP}' as {WIDE}) / 2 then cast(__wide as bigint) end")
                    .alias("keep_id")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    The membership join carries digests instead of texts (SHA-256 and a second 64-bit hash of the content).
    Equal rows of one id are counted first, so that exactly one of them is kept.
    """
    best = winners(docs, id_col, text_col, salts)
    mine = normalised(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), "__text")
    counted = mine.groupBy("__id", "__sha", "__check", "__n").agg(F.count(F.lit(1)).alias("__copies"))
    longest = counted.groupBy("__id", "__sha", "__check").agg(
        F.max("__n").alias("__n"), F.sum("__copies").alias("__copies"))
    return (longest.join(best, ["__sha", "__check"])
            .select("*", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("__nth"))
            .select(F.col("__id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"),
                    (F.col("__id").eqNullSafe(F.col("keep_id")) & (F.col("__nth") == 1)).alias("kept"),
                    F.col("__sha").alias("text_sha256")))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """The rows of `docs` that stay, with all their columns.

    Only groups of several rows are looked up, in a stored narrow table; the rows themselves are shuffled only if that table is
    too large to broadcast."""
    columns = docs.columns
    keep = stored(winners(docs, id_col, text_col, salts).where("group_size > 1").select(
        F.col("__sha").alias("__ksha"), F.col("__check").alias("__kcheck"),
        F.col("keep_id").alias("__keep"), F.col("group_size").alias("__rows")), "exact-groups")
    rows = normalised(docs, text_col).join(
        if_small(keep), (F.col("__sha") == F.col("__ksha")) & (F.col("__check") == F.col("__kcheck")), "left")
    single = rows.where("__rows is null").select(columns)
    # A group can hold its winner's id twice; of such rows the longest, then any one of equals, stays.
    several = rows.where(F.col("__rows").isNotNull() & F.col(id_col).eqNullSafe(F.col("__keep")))
    best = (several.groupBy("__sha", "__check").agg(F.max(F.struct("__n", *_sortable(several, columns))).alias("__row"))
            .select(*[F.col(f"__row.{_tick(c)}").alias(c) for c in _sortable(several, columns)]))
    missing = [c for c in columns if c not in best.columns]
    if missing:  # map columns cannot be compared: any of the equal rows stands for them
        best = (several.groupBy("__sha", "__check").agg(F.max_by(F.struct(*[F.col(_tick(c)) for c in columns]),
                                                                F.col("__n")).alias("__row"))
                .select(*[F.col(f"__row.{_tick(c)}").alias(c) for c in columns]))
    return single.unionByName(best.select(columns))


def _tick(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _sortable(df: DataFrame, columns: list[str]) -> list[str]:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return [c for c in columns if "map<" not in kinds[c] and "variant" not in kinds[c]]


def op7_exact_dedup(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = r"""
with n as (
  select doc_id, length(coalesce(text, '')) as n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents)
select doc_id,
       first_value(doc_id) over w as keep_id,
       count(*) over (partition by text_sha256) as group_size,
       row_number() over w = 1 as kept,
       text_sha256
from n window w as (partition by text_sha256 order by n_chars desc, doc_id nulls last)
"""

QUERIES = {"op7_exact_dedup": (op7_exact_dedup, SQL)}
