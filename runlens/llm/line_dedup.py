"""Line deduplication by winnowing over line hashes, in DataFrame operations only.

A document is its sequence of lines that hold a word, compared without white space at their ends. A run of
consecutive lines with `min_words` words or more that occurs earlier (documents by id, lines by position) is deleted where it
occurs later.

1. Winnowing: the window of a line reaches from it to the first line by which `min_words` words are complete. Its minimal
   line hash is a fingerprint. Equal runs hold equal windows and so equal minima: every repeated run shares a
   fingerprint, and lines without a shared one are dropped here, after one count per fingerprint.
2. In place of joining positions of shared fingerprints and extending each match, which makes pairs, the window forward from a line
   and the window backward to a line are keyed by all their line hashes (twice 64 bits per line, twice 64 per window). A
   maximal repeated run is the union of such windows, whatever the length of the run.
3. Per key the earliest place is found by partial aggregation, not by gathering the places, and joined back; all
   other places are deleted. A passage that stands in a third of all documents costs one row per place, and its
   join is split by Spark.

Defined cases: null text stays null with 0 lines; empty text has one line, without words; lines without words never start or end
a run and go where the lines around them both go; within one document later overlapping repeats go too; rows repeated with one id and
text are one document, and each copy gets its result; null ids come first; of one id with several texts, the order is
that of a text hash; an empty table gives an empty result; other columns pass through `dedup_lines`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runlens.llm.common import WORD, table

MIN_WORDS = 50
TRIMMED = " \t\r\x0b\x0c"
DOC = ["__id", "__key"]


def lines(docs: DataFrame) -> DataFrame:
    """(__id, __key, pos, nth, words, h1, h2) of every line with a word, `nth` counting these; repeated rows once."""
    rows = docs.select("__id", "__key", F.posexplode(F.split("__text", "\n")).alias("pos", "line"))
    rows = rows.select("__id", "__key", "pos", F.btrim("line", F.lit(TRIMMED)).alias("line"))
    rows = (rows.select("__id", "__key", "pos", F.regexp_count("line", F.lit(WORD)).cast("long").alias("words"),
                        F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")).where("words > 0"))
    place = W.partitionBy(DOC).orderBy("pos")
    rows = rows.withColumn("__before", F.lag("pos").over(place)).where("__before is null or __before < pos").drop("__before")
    return rows.withColumn("nth", F.row_number().over(place))


def windows(rows: DataFrame, min_words: int) -> DataFrame:
    """(__id, __key, first, last, nth, upto, mark, fresh, k1, k2): complete windows forward from and backward to each line; `mark` is the
    fingerprint of the window that starts at `first`, `fresh` is 1 where the place of a fingerprint is first selected; nth and upto number the first and last line."""
    place = W.partitionBy(DOC).orderBy("pos")
    rows = (rows.withColumn("upto", F.sum("words").over(place.rowsBetween(W.unboundedPreceding, 0)))
            .withColumn("ahead", F.col("upto") - F.col("words"))
            .withColumn("total", F.sum("words").over(W.partitionBy(DOC))))
    forward = W.partitionBy(DOC).orderBy("ahead").rangeBetween(0, min_words - 1)
    backward = W.partitionBy(DOC).orderBy("upto").rangeBetween(-(min_words - 1), 0)
    pair = F.struct("h1", "h2")
    rows = (rows.withColumn("f_last", F.max(F.struct("pos", "nth")).over(forward))
            .withColumn("f_least", F.min(F.struct("h1", "pos")).over(forward))
            .withColumn("f_mark", F.col("f_least.h1"))
            # Windows that share one place of their minimum are neighbours: the fingerprint is counted at the first.
            .withColumn("f_fresh", F.coalesce(F.lag("f_least.pos").over(place) != F.col("f_least.pos"), F.lit(True)))
            .withColumn("f_hashes", F.collect_list(pair).over(forward))
            .withColumn("b_first", F.min(F.struct("pos", "nth")).over(backward))
            .withColumn("b_mark", F.first("f_mark").over(backward))
            .withColumn("b_reach", F.first("f_last.pos").over(backward))
            .withColumn("b_hashes", F.collect_list(pair).over(backward)))
    shape = lambda first, last, mark, fresh, hashes: F.struct(
        F.col(f"{first}pos").alias("first"), F.col(f"{last}pos").alias("last"), F.col(f"{first}nth").alias("nth"),
        F.col(f"{last}nth").alias("upto"), F.col(mark).alias("mark"), fresh.cast("int").alias("fresh"),
        F.xxhash64(hashes).alias("k1"), F.xxhash64(F.lit(1), hashes).alias("k2"))
    ahead = F.when(F.col("total") - F.col("ahead") >= min_words, shape("", "f_last.", "f_mark", F.col("f_fresh"), "f_hashes"))
    # A backward window that is also the forward window of its first line is there already.
    back = F.when((F.col("upto") >= min_words) & (F.col("b_reach") < F.col("pos")),
                  shape("b_first.", "", "b_mark", F.lit(False), "b_hashes"))
    return (rows.select(*DOC, F.explode(F.filter(F.array(ahead, back), lambda w: w.isNotNull())).alias("w"))
            .select(*DOC, "w.*"))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(__id, __key, runs): per document the line ranges [first, last] to delete, apart and in order."""
    found = windows(lines(docs), min_words)
    marks = found.groupBy("mark").agg(F.sum("fresh").alias("n")).where("n > 1").select("mark")
    candidates = found.join(marks, "mark", "left_semi")
    earliest = (candidates.groupBy("k1", "k2")
                .agg(F.min(F.struct(*DOC, "first")).alias("origin"), F.count(F.lit(1)).alias("n"))
                .where("n > 1").drop("n"))
    later = (candidates.join(earliest, ["k1", "k2"])
             .where(~F.struct(*DOC, "first").eqNullSafe(F.col("origin"))).select(*DOC, "first", "last", "nth", "upto"))
    place = W.partitionBy(DOC).orderBy("nth", "upto")
    reach = F.max("upto").over(place.rowsBetween(W.unboundedPreceding, -1))
    new = (F.col("nth") > F.coalesce(reach + 1, F.lit(-1))).cast("int")
    return (later.withColumn("new", new)
            .withColumn("run", F.sum("new").over(place.rowsBetween(W.unboundedPreceding, 0)))
            .groupBy(*DOC, "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
            .groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` with line_count, line_removed (both over all lines) and line_text, the text without later repeated runs."""
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    keyed = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), key.alias("__key"))
    runs = repeated_runs(keyed, min_words).select(F.col("__id").alias("__run_id"), F.col("__key").alias("__run_key"), F.col("runs").alias("__runs"))
    rows = docs.withColumn("__key", key)
    rows = rows.join(runs, (F.col("__key") == F.col("__run_key")) & F.col(id_col).eqNullSafe(F.col("__run_id")), "left")
    parts = F.split(F.col(text_col), "\n")
    kept = F.filter(parts, lambda line, i: ~F.exists("__runs", lambda r: (r["first"] <= i) & (i <= r["last"])))
    gone = F.aggregate("__runs", F.lit(0).cast("long"), lambda s, r: s + r["last"] - r["first"] + 1)
    return rows.select(*docs.columns,
                       F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(parts)).cast("long").alias("line_count"),
                       F.coalesce(gone, F.lit(0)).cast("long").alias("line_removed"),
                       F.when(F.col("__runs").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")).alias("line_text"))


def op2_line_dedup(spark, sf_dir):
    rows = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.col("line_count").alias("n_lines"), F.col("line_removed").alias("n_removed"),
                       F.col("line_text").alias("text"))


SQL = r"""
with p as (select doc_id, string_split(text, chr(10)) as parts from documents),
u as (select doc_id, unnest(parts) as raw, generate_subscripts(parts, 1) - 1 as pos from p),
l as (select doc_id, pos, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) as line,
        len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')) as words from u),
c as (select *, sum(words) over (partition by doc_id order by pos) as upto,
        sum(words) over (partition by doc_id) as total from l where words > 0),
a as (select *, upto - words as ahead from c),
w as (select doc_id, pos, upto, total, ahead,
        max(pos) over f as f_last, list(line) over f as f_lines, min(pos) over b as b_first, list(line) over b as b_lines
      from a
      window f as (partition by doc_id order by ahead range between current row and 49 following),
             b as (partition by doc_id order by upto range between 49 preceding and current row)),
g as (select doc_id, pos as first, f_last as last, f_lines as body from w where total - ahead >= 50
      union
      select doc_id, b_first, pos, b_lines from w where upto >= 50),
r as (select *, row_number() over (partition by body order by doc_id, first) as nth from g),
h as (select distinct a.doc_id, a.pos from a join r on a.doc_id = r.doc_id and a.pos between r.first and r.last where r.nth > 1),
m as (select u.doc_id, u.pos, case when a.pos is null then null else h.pos is not null end as cut
      from u left join a on u.doc_id = a.doc_id and u.pos = a.pos left join h on u.doc_id = h.doc_id and u.pos = h.pos),
z as (select doc_id, pos, last_value(cut ignore nulls) over (partition by doc_id order by pos) as here,
        first_value(cut ignore nulls) over (partition by doc_id order by pos rows between current row and unbounded following) as there
      from m),
x as (select doc_id, pos from z where here and there),
k as (select u.doc_id, string_agg(u.raw, chr(10) order by u.pos) as text from u anti join x on u.doc_id = x.doc_id and u.pos = x.pos
      group by u.doc_id),
n as (select doc_id, count(*) as gone from x group by doc_id)
select d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::bigint as n_lines, coalesce(n.gone, 0)::bigint as n_removed,
       case when d.text is null then null else coalesce(k.text, '') end as text
from documents d left join k using (doc_id) left join n using (doc_id)
"""

QUERIES = {"op2_line_dedup": (op2_line_dedup, SQL)}
