import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.operators import spectra
from runlens.plans import characterise as ch
from runlens.plans.study import Study
from runlens.schema import CHANNELS, Learning, Numerics, PipelineConfig, Ranking, SpectrumConfig, Window, fingerprint
from runlens.sources import runs as rd
from runlens.sources import store

from helpers import make_runs


def test_reader_prunes_checks_and_casts(spark, tmp_path):
    cols = ["faultNumber", "simulationRun", "sample", *CHANNELS]
    lines = ["," + ",".join(cols)]
    for run in (1, 2, 3):
        lines += [f"{i}," + ",".join(["0.0", f"{run}.0", str(i)] + [str(i + c / 100) for c in range(52)]) for i in range(1, 5)]
    path = tmp_path / "a.csv"
    path.write_text("\n".join(lines) + "\n")
    df = rd.read_runs(spark, str(path), runs_per_fault=2)
    assert df.count() == 8 and df.columns == ["faultNumber", "simulationRun", "sample", "x"]
    assert dict(df.dtypes)["faultNumber"] == "int"
    assert np.isclose(df.where("simulationRun = 2 and sample = 3").first()["x"][51], 3.51)
    with pytest.raises(ValueError, match="columns missing"):
        rd.read_runs(spark, str(path), channels=["xmeas_1", "nowhere"])


def test_split_reader_puts_both_files_together(spark, tmp_path):
    cols = ["faultNumber", "simulationRun", "sample", "xmeas_1"]
    for fault, name in enumerate(("TEP_FaultFree_Training.csv", "TEP_Faulty_Training.csv")):
        (tmp_path / name).write_text("\n".join([",".join(cols)] + [f"{fault},1,{i},{i}.5" for i in range(1, 31)]) + "\n")
    df = rd.read_split(spark, str(tmp_path), "train", ["xmeas_1"])
    assert df.count() == 60
    ready = rd.prepare_runs(df, "train", length=10)
    assert {r["faultNumber"]: (r["lo"], r["n"]) for r in ready.groupBy("faultNumber").agg(
        F.min("sample").alias("lo"), F.count("*").alias("n")).collect()} == {0: (21, 10), 1: (21, 10)}


def test_missing_spectra_name_the_step(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="characterise"):
        store.read_spectra(spark, str(tmp_path), SpectrumConfig("pca"), "train")


def test_fingerprint_sees_every_parameter():
    a = PipelineConfig((("raw",),))
    assert fingerprint(a) != fingerprint(PipelineConfig((("raw",),), numerics=Numerics(lags=3)))
    assert fingerprint(a) == fingerprint(PipelineConfig((("raw",),)))


def test_interrupted_extraction_goes_on(spark, tmp_path):
    df, _ = make_runs(spark, {(0, r): 5 for r in range(40)})
    seen = []

    def build(part, fail_at=None):
        seen.append(1)
        if len(seen) == fail_at:
            raise RuntimeError("executor gone")
        return part.groupBy("faultNumber", "simulationRun").agg(F.count("*").alias("n"))

    with pytest.raises(RuntimeError):
        store.extract_resumable(spark, df, str(tmp_path), lambda p: build(p, fail_at=3), buckets=8, per_wave=2)
    seen.clear()
    out = store.extract_resumable(spark, df, str(tmp_path), build, buckets=8, per_wave=2)
    assert len(seen) == 2
    assert out.count() == 40 and out.agg(F.sum("n")).first()[0] == 200


def test_waves_read_their_buckets_only(spark, tmp_path):
    """Stored rows are pruned by folder, not computed again after an interruption, and gone when all buckets are done."""
    df, _ = make_runs(spark, {(0, r): 5 for r in range(40)})
    calls, plans = [], []

    def rows():
        calls.append(1)
        return df.withColumn("x", F.transform("x", lambda v: v + 1))

    def build(part, fail=False):
        plans.append(part._jdf.queryExecution().executedPlan().toString())
        if fail and len(plans) == 2:
            raise RuntimeError("executor gone")
        return part.groupBy("faultNumber", "simulationRun").agg(F.count("*").alias("n"))

    with pytest.raises(RuntimeError):
        store.extract_resumable(spark, rows, str(tmp_path), lambda p: build(p, True), buckets=6, per_wave=2)
    out = store.extract_resumable(spark, rows, str(tmp_path), build, buckets=6, per_wave=2)
    assert len(calls) == 1 and len(plans) == 4 and out.count() == 40
    assert all("PartitionFilters: [run_bucket" in p and "transform(" not in p for p in plans)
    assert not (tmp_path / "_rows").exists()
    with pytest.raises(RuntimeError, match="no run"):
        store.extract_resumable(spark, df.where("simulationRun < 0"), str(tmp_path / "none"), build, buckets=2)


def test_study_end_to_end(spark, tmp_path):
    lengths = {(f, r): 60 for f in (0, 1) for r in range(1, 13)}
    df, _ = make_runs(spark, lengths, width=3)
    df = df.drop("t").withColumn("x", F.when(F.col("faultNumber") == 1, F.transform("x", lambda v: v * 3)).otherwise(F.col("x")))
    reads = []

    def read(split):
        reads.append(split)
        return df.where("simulationRun <= 9" if split == "train" else "simulationRun > 9")

    cfg = PipelineConfig((("raw",), ("pca", 1)), run_length=40, feature_set="minimal", ranking=Ranking(top_k=4), learning=Learning(folds=2),
                         labels=(0, 1))

    def study():
        return Study(spark, cfg, read, str(tmp_path), ["a", "b", "c"], {"train": 21, "test": 21}, buckets=4, per_wave=2)

    board = study().summary(["NearestCentroid", "GaussianMoments"])
    assert {(r["config"], r["model"]) for r in board.collect()} == {(c, m) for c in ("raw", "pca_1") for m in
                                                                  ("NearestCentroid", "GaussianMoments")}
    assert board.agg(F.max("macro_f1")).first()[0] > 0.6
    reads.clear()
    views = study().compare(["NearestCentroid", "GaussianMoments"])
    assert reads == [] and views["best_per_config"].count() == 2 and views["gap"].count() == 2
    cm, scores = study().confusion(trees=5)
    assert cm.count() == 2 * 4
    assert {(r["config"], r["n_features"], r["n_train"]) for r in scores.collect()} == {("raw", 4, 18), ("pca_1", 4, 18)}


def test_spectra_of_test_runs_are_computed_once(spark, tmp_path):
    df, _ = make_runs(spark, {(f, r): 40 for f in (0, 1) for r in range(1, 5)}, width=2)
    df = df.drop("t")
    cfgs = [SpectrumConfig(m, window=Window(5)) for m in ("pca", "cva")]
    for c in cfgs:
        store.write_spectra(ch.characterise(df, c, 2, dense=True)[0], str(tmp_path), c, "train")
    calls = []

    def test_df():
        calls.append(1)
        return df

    first = ch.combine(ch.spectra_sets(spark, str(tmp_path), cfgs, test_df, 2, dense=True))
    again = ch.spectra_sets(spark, str(tmp_path), cfgs, test_df, 2, dense=True)
    assert len(calls) == 2 and set(first) == {"PCA", "CVA", "PCA+CVA"} and set(again) == {"PCA", "CVA"}
    assert len(first["PCA+CVA"][0].first()["values"]) == 4
    assert ch.distribution(first).count() == 2
    assert spectra.success_counters(again["PCA"][0]).first()["runs"] == 8


def test_quick_trial_and_failed_models_have_rows(spark):
    cfg = PipelineConfig((("raw",),), numerics=Numerics(lags=3))
    assert cfg.quick().ranking.top_k == 20 and cfg.quick().numerics.lags == 3 and cfg.quick().runs == 4
    from runlens.operators import models

    rows = [(i, i % 2, [float(i % 2), float(i)]) for i in range(40)]
    df = spark.createDataFrame(rows, "run_id bigint, label int, x array<double>")
    models.PLAIN_MODELS["Broken"] = lambda train, test: 1 / 0
    try:
        _, board = models.compare_models(df, df, [0, 1], "c", ["NearestCentroid", "Broken"], cv_folds=0)
    finally:
        del models.PLAIN_MODELS["Broken"]
    got = {r["model"]: (r["status"], r["error"], r["macro_f1"]) for r in board.collect()}
    assert got["NearestCentroid"][0] == "ok" and got["Broken"][0] == "failed" and "ZeroDivision" in got["Broken"][1]
    assert got["Broken"][2] is None


def test_configs_share_the_prepared_samples_of_a_split(spark, tmp_path):
    """Every split is read, numbered and stored once for all configs; the samples go when all are extracted."""
    df, _ = make_runs(spark, {(f, r): 45 for f in (0, 1) for r in range(1, 9)}, width=2)
    df = df.drop("t").withColumn("x", F.when(F.col("faultNumber") == 1, F.transform("x", lambda v: v * 3)).otherwise(F.col("x")))
    reads = []

    def read(split):
        reads.append(split)
        return df.where("simulationRun <= 6" if split == "train" else "simulationRun > 6")

    cfg = PipelineConfig((("raw",), ("pca", 1)), run_length=20, feature_set="minimal", ranking=Ranking(top_k=3), learning=Learning(folds=0),
                         labels=(0, 1))
    study = Study(spark, cfg, read, str(tmp_path), ["a", "b"], {"train": 21, "test": 21}, buckets=4, per_wave=2)
    got = {n: (tr.count(), te.count()) for n, (tr, te) in study.matrices().items()}
    assert got == {"raw": (12, 4), "pca_1": (12, 4)}
    assert sorted(reads) == ["test", "train"]
    assert not list(tmp_path.glob("samples/*")) and not list(tmp_path.glob("read/*"))
