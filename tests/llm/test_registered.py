"""Registered queries against their SQL, and those without SQL against brute force, over whole small tables."""

import html as entities
import math
import re
from collections import Counter

import duckdb
import pytest

from runlens.llm.queries import registry

from .test_text_ops import base_truth, license_base, processor

SF = "/root/testdata/sf0.001"
QUERIES = registry()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_all_operators_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_same_rows_as_sql(spark, con, name):
    fn, sql = QUERIES[name]
    df, rel = fn(spark, SF), con.sql(sql)
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    clean = lambda v: round(v, 9) if isinstance(v, float) and not math.isnan(v) else v
    assert Counter(tuple(clean(r[c]) for c in cols) for r in df.collect()) == Counter(
        tuple(clean(r[i]) for i in at) for r in rel.fetchall())


def test_queries_without_sql_against_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op3_quality_rules"][0](spark, SF).collect()
    assert {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in rows} == {
        i: base_truth(t) for i, t in texts.items()}
    rows = QUERIES["op5_license_scan"][0](spark, SF).collect()
    assert {r["doc_id"]: tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) for r in rows} == {
        i: license_base(t) for i, t in texts.items()}
    sp = processor()
    rows = QUERIES["op8_sentencepiece"][0](spark, SF).collect()
    assert {r["doc_id"]: (r["piece_ids"], r["round_trip"]) for r in rows} == {i: (sp.encode(t), True) for i, t in texts.items()}
    rows = QUERIES["op9_toxicity"][0](spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(texts) and all(0 <= r["p_toxic"] <= 1 for r in rows)
    rows = QUERIES["op4_html_text"][0](spark, SF).collect()
    got = {r["page_id"]: r["text"] for r in rows}
    for p in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.search(r"<article>(.*)</article>", p["html"], re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?p>|<br>|</?h1>", body)]
        assert got[p["page_id"]] == "\n".join(b for b in blocks if b)
