"""Queries on tables made to show what the given ones do not: short runs, many runs, many values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import registry, views
from runlens.operators import ica, prep, projections
from runlens.plans import characterise
from runlens.schema import PipelineConfig, SpectrumConfig, Window

from helpers import by_sql, given_tables, make_runs


def same(spark, folder, name, tables=("lineitem", "events")):
    fn, sql = registry()[name]
    df = fn(spark, folder)
    rows = by_sql(folder, f"SELECT {', '.join(chr(34) + c + chr(34) for c in df.columns)} FROM ({sql})", tables)
    assert sorted(tuple(r) for r in df.collect()) == rows and rows


@pytest.mark.parametrize("name", ["io4_read_test", "io2_read_split", "io2_gapped_runs"])
def test_short_runs_stay_as_in_sql(spark, tmp_path, name):
    """One run ends inside the window (149 of 150 samples, 20 of 38 events), one before it begins."""
    same(spark, given_tables(tmp_path, {("N", 1): 200, ("N", 2): 149, ("A", 1): 170, ("R", 1): 160, ("R", 2): 40}, {1: 60, 2: 20, 3: 1}), name)


def test_runs_iterate_together_as_one_by_one():
    rng = np.random.RandomState(5)
    mixed = [rng.laplace(size=(n, 3)) @ rng.normal(size=(3, 3)) for n in (40, 41, 300, 120, 40)]
    whites = [(x - x.mean(0)) @ ica.whitening(x.mean(0), np.cov(x.T, bias=True), len(x), 3).T for x in mixed]
    for steps, tol in ((1, 1e-3), (200, 1e-6)):
        for white, (w, lim) in zip(whites, ica.solve_together(whites, 3, steps, tol, 42)):
            one, far = ica.start(3, 42), np.inf
            for _ in range(steps):
                one, far = ica.step(one, *ica.step_sums(one, white), len(white))
                if far < tol:
                    break
            assert np.allclose(w, one, atol=1e-8) and np.isclose(lim, far, atol=1e-8)


@pytest.mark.parametrize("spec", [("pca", 2), ("ica", 2), ("dyca", 1, 2)])
def test_a_projection_prepares_its_rows_once(spark, spec):
    df, data = make_runs(spark, {(0, 1): 60, (1, 1): 45}, width=2)
    seen = spark.sparkContext.accumulator(0)

    def passing(frames):
        for pdf in frames:
            seen.add(len(pdf))
            yield pdf

    rows = df.mapInPandas(passing, df.schema)
    out = projections.project(rows, spec, projections.Context(PipelineConfig((spec,)), 2))
    assert out.where("x[0] is not null").count() == 105
    assert seen.value == 105


def test_numbering_brings_fewer_counts_together_than_rows(spark, tmp_path):
    folder = given_tables(tmp_path, {("N", 1): 300, ("A", 2): 300}, {1: 60})
    li = views.run_values(spark, folder)
    blocks = li.select("faultNumber", "simulationRun", F.expr(f"floor(datediff(l_shipdate, '1990-01-01') / {views.DAYS})")).distinct()
    assert blocks.count() < li.count() / 8
    a, b = prep.fit_scaler(li), prep.fit_scaler(views.runs(spark, folder))
    assert np.allclose(a.mean, b.mean) and np.allclose(a.std, b.std)


def test_spectra_are_computed_once_for_check_statistics_and_store(spark, tmp_path):
    df, _ = make_runs(spark, {(0, 1): 60, (1, 1): 85}, width=2)
    seen = spark.sparkContext.accumulator(0)

    def passing(frames):
        for pdf in frames:
            seen.add(len(pdf))
            yield pdf

    per_run, by_class = characterise.characterise(df.mapInPandas(passing, df.schema), SpectrumConfig("pca", window=Window(21)), 2)
    read = seen.value
    per_run.write.parquet(f"{tmp_path}/spectra")
    assert by_class.count() == 4 and per_run.count() == 2
    assert read and seen.value == read


def test_large_products_are_not_one_formula_and_signs_are(spark):
    """48 products written out took three times the time of array functions; signs of a few channels need none."""
    df, _ = make_runs(spark, {(0, 1): 30, (1, 2): 25}, width=12)
    w = np.random.RandomState(6).normal(size=(4, 12))
    loads = spark.createDataFrame([(f, r, n - 1, w.tolist(), [0.5, 1.0, 1.5, 2.0], "ok") for f, r, n in ((0, 1, 30), (1, 2, 25))],
                                  "faultNumber int, simulationRun int, last_t bigint, w array<array<double>>, b array<double>, status string")
    got = projections.apply_loadings(df.withColumn("z", F.col("x")), loads, 4000, (4, 12))
    assert "lambda" in got._jdf.queryExecution().optimizedPlan().toString()
    for r in got.join(df.withColumnRenamed("x", "z"), ["faultNumber", "simulationRun", "t"]).collect():
        assert np.allclose(r["x"], w @ np.array(r["z"]) - [0.5, 1.0, 1.5, 2.0])
    turned = prep.flip_signs(df, 2)
    assert "zip_with" not in turned._jdf.queryExecution().analyzed().toString()
