import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.operators import prep, windows

from helpers import by_run, make_runs

# One run holds most rows; blocks of 16 samples cut it into many pieces.
LENGTHS = {(0, 1): 400, (0, 2): 33, (1, 1): 16, (1, 2): 17, (2, 1): 5}


@pytest.mark.parametrize("block", [16, 4000])
def test_lag_stack_matches_numpy(spark, block):
    df, data = make_runs(spark, LENGTHS)
    got = by_run(windows.lag_stack(df, 2, block=block), "x")
    for key, x in data.items():
        assert np.array_equal(got[key], np.hstack([x[2 - k:len(x) - k] for k in range(3)]))


@pytest.mark.parametrize("block", [16, 4000])
def test_past_future_stack(spark, block):
    df, data = make_runs(spark, LENGTHS)
    out = windows.past_future_stack(df, 2, 3, block=block)
    p, f = by_run(out, "p"), by_run(out, "f")
    for key, x in data.items():
        at = range(2, len(x) - 2)
        assert np.array_equal(p[key], np.array([np.concatenate([x[t - 1], x[t - 2]]) for t in at]))
        assert np.array_equal(f[key], np.array([np.concatenate([x[t], x[t + 1], x[t + 2]]) for t in at]))


@pytest.mark.parametrize("block", [16, 4000])
def test_derivative_is_gradient(spark, block):
    df, data = make_runs(spark, LENGTHS)
    got = by_run(windows.derivative(df, block=block), "dx")
    for key, x in data.items():
        assert np.allclose(got[key], np.gradient(x, axis=0))


def test_position_with_gaps_and_any_block(spark):
    df, _ = make_runs(spark, LENGTHS)
    gaps = df.where("sample % 3 <> 0").drop("t")
    for block in ("sample div 7", "sample div 100000"):
        pdf = windows.with_position(gaps, block=F.expr(block)).toPandas().sort_values(["faultNumber", "simulationRun", "sample"])
        for _, g in pdf.groupby(["faultNumber", "simulationRun"]):
            assert list(g["t"]) == list(range(len(g)))


def test_no_window_holds_more_than_a_block_and_its_halo(spark):
    df, _ = make_runs(spark, LENGTHS)
    sizes = windows.with_halo(df, 3, 2, 16).groupBy("faultNumber", "simulationRun", "blk_16").count()
    assert sizes.agg(F.max("count")).first()[0] <= 16 + 3 + 2


def test_attach_per_run_keeps_every_sample(spark):
    df, _ = make_runs(spark, LENGTHS)
    side = df.groupBy("faultNumber", "simulationRun").agg(F.max("t").alias("last_t"), F.count("*").alias("n"))
    out = windows.attach_per_run(df, side, block=16)
    assert out.count() == sum(LENGTHS.values())
    assert out.where("n is null").count() == 0


def test_fixed_length_stops_on_a_short_run(spark):
    df, _ = make_runs(spark, LENGTHS)
    with pytest.raises(Exception, match="shorter than the fixed length"):
        windows.fixed_length(df, 10).collect()
    assert windows.fixed_length(df, 5).count() == 5 * len(LENGTHS)


def test_cutoffs_and_heads(spark):
    df, _ = make_runs(spark, {(0, 1): 30, (1, 1): 30})
    sizes = {r["faultNumber"]: r["count"] for r in prep.drop_pre_fault(df, 21).groupBy("faultNumber").count().collect()}
    assert sizes == {0: 30, 1: 10}
    assert prep.drop_pre_fault(df, 21, uniform=True).count() == 20
    assert windows.head_per_run(df, 7, 3).count() == 10
    assert windows.head_per_run(df, None, 3).count() == 33


def test_min_samples_reports_skipped_runs(spark):
    df, _ = make_runs(spark, LENGTHS)
    kept, table = windows.min_samples(df, 17)
    assert kept.count() == 400 + 33 + 17
    assert {r["status"]: r["count"] for r in table.groupBy("status").count().collect()} == {"ok": 3, "skipped": 2}


def test_sign_rule_edge_cases(spark):
    rows = [(0, 1, 1, 0, [-3.0, 0.0, 1.0]), (0, 1, 2, 1, [3.0, 0.0, -2.0])]
    df = spark.createDataFrame(rows, "faultNumber int, simulationRun int, sample int, t bigint, x array<double>")
    assert by_run(prep.flip_signs(df, 3), "x")[0, 1].tolist() == [[3.0, 0.0, -1.0], [-3.0, 0.0, 2.0]]


def test_scaler_uses_normal_operation_and_keeps_constant_channels(spark):
    rows = [(0, 1, i, i, [float(i), 7.0]) for i in range(4)] + [(1, 1, 0, 0, [100.0, 9.0])]
    df = spark.createDataFrame(rows, "faultNumber int, simulationRun int, sample int, t bigint, x array<double>")
    s = prep.fit_scaler(df)
    assert s.mean == (1.5, 7.0) and np.allclose(s.std, (np.std(range(4)), 1.0))


def test_spectrum_transform_edges(spark):
    df = spark.createDataFrame([([0.0, 2.0],), ([4.0, 2.0],)], "v array<double>")
    log = [r[0] for r in df.select(prep.spectrum_transform("v", "log")).collect()]
    assert log[0][0] == -12.0
    rel = [r[0] for r in df.select(prep.spectrum_transform("v", "relative")).collect()]
    assert rel == [[0.0, 2.0], [1.0, 0.5]]


def test_run_keys_never_collide(spark):
    from runlens.operators import prep, sets

    pairs = [(0, 1001), (1, 1), (2, 1), (1, 1001), (0, 2001), (20, 2**31 - 1), (0, 0), (3, -5)]
    df = spark.createDataFrame(pairs, "faultNumber int, simulationRun int").withColumn("run_id", prep.run_key())
    assert df.select("run_id").distinct().count() == len(pairs)
    back = prep.key_columns(df.select("run_id"))
    assert {(r["faultNumber"], r["simulationRun"]) for r in back.collect()} == set(pairs)
    both = df.withColumn("split", F.lit("train"))
    a, b = both.where("simulationRun = 1001 and faultNumber = 0"), both.where("simulationRun = 1 and faultNumber = 1")
    seen = a.withColumn("config", F.lit("A")).unionByName(b.withColumn("config", F.lit("B")))
    assert sets.common_runs(seen, 2).count() == 0


def test_gaps_never_drop_samples(spark):
    from runlens.sources.runs import prepare_runs

    rows = [(0, 1, s, [float(s)]) for s in range(1, 151) if s % 3]
    df = spark.createDataFrame(rows, "faultNumber int, simulationRun int, sample int, x array<double>")
    kept = prepare_runs(df, cutoff=1, length=100)
    assert kept.count() == 100 and kept.agg(F.max("t")).first()[0] == 99
    for length in (100, None):
        with pytest.raises(Exception, match="gaps"):
            prepare_runs(df, cutoff=1, length=length, dense=True).collect()
    whole = spark.createDataFrame([(0, 1, s, [1.0]) for s in range(1, 101)], df.schema)
    assert prepare_runs(whole, cutoff=1, length=None, dense=True).count() == 100
