"""Trees grown in the tasks against those of pyspark.ml, and their parts."""

import numpy as np
import pytest

from runlens.operators import forest, models
from runlens.plans import characterise


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.RandomState(0)
    x = rng.normal(size=(2400, 6))
    y = (x[:, 0] * x[:, 1] > 0).astype(int) + 2 * (x[:, 2] + 0.3 * rng.normal(size=2400) > 0.5)
    df = spark.createDataFrame([(i, int(y[i]), [float(v) for v in x[i]]) for i in range(2400)],
                               "run_id bigint, label int, x array<double>").repartition(5).cache()
    return df.where("run_id % 4 <> 0"), df.where("run_id % 4 = 0")


def predictions(rows, name):
    got = models.fit_predict(*rows, models.zoo(6, 4, 42, 15)[name]).toPandas().sort_values("run_id")
    return got["run_id"].tolist(), (got["y_true"] == got["y_pred"]).mean(), got["y_pred"].tolist()


@pytest.mark.parametrize("name", ["DecisionTreeClassifier", "RandomForestClassifier"])
def test_trees_of_many_rows_grow_in_the_tasks(spark, rows, name, monkeypatch):
    """Beyond DRIVER_ROWS pyspark.ml gets no tree to grow; nodes cut by histograms or not, the forest is as good and always the same."""
    ids, known, _ = predictions(rows, name)
    monkeypatch.setattr(models, "DRIVER_ROWS", 100)
    estimator = type(models.zoo(6, 4)[name])
    monkeypatch.setattr(estimator, "_fit", lambda *a: pytest.fail("grown in the driver"))
    whole = predictions(rows, name)
    again = predictions([df.repartition(3) for df in rows], name) if name == "DecisionTreeClassifier" else predictions(rows, name)
    monkeypatch.setattr(forest, "LOCAL", 200)
    parts = predictions(rows, name)
    assert whole[0] == ids == parts[0] and whole == again
    assert abs(whole[1] - known) < 0.05 and abs(parts[1] - known) < 0.05
    if name == "DecisionTreeClassifier":
        assert whole == parts


def test_a_subtree_fits_its_rows_and_equal_sisters_merge():
    rng = np.random.RandomState(1)
    bins, how = rng.randint(0, 32, size=(500, 3)).astype(np.uint8), forest.Grown(1, 30)
    label = (bins[:, 0] > 12).astype(np.int64) + (bins[:, 1] > 20)
    tree = forest.Subtree(bins, label, np.ones(500, dtype=np.int64), 3, how, 0, 1)
    assert (tree.vote(bins).argmax(1) == label).all() and (tree.feature >= 0).sum() < 12
    none = forest.Subtree(np.zeros((4, 3), dtype=np.uint8), np.array([0, 1, 1, 2]), np.array([5, 1, 1, 0]), 3, how, 0, 1)
    assert len(none.feature) == 1 and np.allclose(none.votes[0] / forest.VOTE, [5 / 7, 2 / 7, 0])
    flat = forest.Subtree(bins, label, np.ones(500, dtype=np.int64), 3, forest.Grown(1, 2), 0, 1)
    assert len(flat.feature) <= 7


def test_borders_part_all_of_few_values_and_even_shares_of_many():
    assert forest.borders_of(np.array([3.0, 1.0, 1.0, 2.0]), 32).tolist() == [1.5, 2.5]
    assert len(forest.borders_of(np.full(9, 4.0), 32)) == 0
    values = np.exp(np.random.RandomState(2).normal(size=20_000) * 4)
    cuts = forest.borders_of(values, 32)
    share = np.bincount(np.searchsorted(cuts, values), minlength=32) / len(values)
    assert len(cuts) == 31 and np.allclose(share, 1 / 32, atol=1e-3)
    drawn = forest.draws(np.arange(100_000), 3, forest.Grown(20, 30))
    assert np.allclose(np.bincount(drawn)[:4] / 100_000, [0.3679, 0.3679, 0.1839, 0.0613], atol=0.01)
    assert (drawn != forest.draws(np.arange(100_000), 4, forest.Grown(20, 30))).any()


def no_driver_trees(monkeypatch):
    monkeypatch.setattr(models, "DRIVER_ROWS", 10)
    for estimator in models.zoo(6, 4).values():
        if type(estimator).__name__ in ("DecisionTreeClassifier", "RandomForestClassifier"):
            monkeypatch.setattr(type(estimator), "_fit", lambda *a: pytest.fail("grown in the driver"))


def test_compared_trees_of_many_rows_grow_in_the_tasks(spark, rows, monkeypatch):
    no_driver_trees(monkeypatch)
    _, board = models.compare_models(*rows, [0, 1, 2, 3], "all", ["DecisionTreeClassifier", "NearestCentroid"], cv_folds=2)
    got = {r["model"]: r for r in board.collect()}
    tree = got["DecisionTreeClassifier"]
    assert tree["status"] == "ok" and tree["balanced_acc"] > 0.7 and abs(tree["cv_mean"] - tree["balanced_acc"]) < 0.1
    assert got["NearestCentroid"]["status"] == "ok"


def test_forests_on_spectra_of_many_runs_grow_in_the_tasks(spark, monkeypatch):
    no_driver_trees(monkeypatch)
    rng = np.random.RandomState(4)
    sets = [spark.createDataFrame([(f, r, [float(v) for v in rng.normal(size=3) + 4 * f]) for f in (0, 1, 2) for r in range(lo, lo + n)],
                                  "faultNumber int, simulationRun int, values array<double>") for lo, n in ((1, 20), (30, 8))]
    board, cm = characterise.classify_spectra({"PCA": tuple(sets)}, [0, 1, 2], ["NearestCentroid"], cv_folds=0, trees=5)
    hits = sum(r["n"] for r in cm.collect() if r["y_true"] == r["y_pred"])
    assert board.first()["status"] == "ok" and cm.count() == 9 and hits >= 22
