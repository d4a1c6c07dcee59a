"""Registered queries against their SQL on the smallest tables (a selection; tools/check.py runs all)."""

import math
from collections import Counter

import duckdb
import pytest

from checks import registry

SF = "/root/testdata/sf0.001"
TABLES = "lineitem events embeddings".split()
NAMES = ("p4_drop_pre_fault p6_scale_global_mean p12_flip_signs w5_lag_stack w7_derivative a9_classification_report "
         "t3_top_confusions m6_gaussian_nb p8_impute_range a15_mann_whitney t1_rank_features a17_moments_partial "
         "d1_a1_pca_shares_by_class d3_cva_spectrum d4_w7_dyca_spectrum d6_d7_j3_lda_spectrum v2_project_pca "
         "f3_quantiles_blocks f10_changes_blocks f14_strikes_blocks f16_change_quantiles f19_chunk_trend").split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def clean(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, con, name):
    fn, sql = registry()[name]
    df = fn(spark, SF)
    cols = sorted(df.columns)
    got = Counter(tuple(clean(r[c]) for c in cols) for r in df.collect())
    rel = con.sql(sql)
    at = [rel.columns.index(c) for c in cols]
    assert got == Counter(tuple(clean(r[i]) for i in at) for r in rel.fetchall())


def test_every_query_has_a_home():
    assert len(registry()) > 100
