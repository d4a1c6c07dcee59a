import itertools
import math
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.functions.special import fisher_two_sided, student_two_sided
from runlens.operators import baselines, discriminants, metrics, models, neighbours, ranking, reports, sets
from runlens.operators.values import ordered_counts, quantiles, value_counts


def preds(spark, pairs):
    return spark.createDataFrame([("a", i, t, p) for i, (t, p) in enumerate(pairs)],
                                 "config string, run_id bigint, y_true int, y_pred int")


def test_absent_and_never_predicted_classes(spark):
    cm = metrics.confusion_counts(preds(spark, [(0, 0), (0, 1), (1, 1), (1, 1)]), [0, 1, 2])
    assert cm.count() == 9
    shares = {(r["y_true"], r["y_pred"]): r["share"] for r in metrics.normalize_rows(cm).collect()}
    assert shares[2, 2] == 0.0 and shares[0, 1] == 0.5
    row = metrics.scores(cm).first()
    assert row["balanced_acc"] == 0.75
    assert math.isclose(row["macro_f1"], (2 / 3 + 4 / 5) / 2)
    report = {r["name"]: r for r in metrics.classification_report(cm).collect()}
    assert report["2"]["f1"] == 0.0 and report["accuracy"]["f1"] == 0.75


def test_perfect_predictions_have_no_confusions(spark):
    cm = metrics.confusion_counts(preds(spark, [(0, 0), (1, 1)]), [0, 1])
    assert metrics.top_confusions(cm).count() == 0


def test_views_without_cross_validation(spark):
    board = spark.createDataFrame([("a", "m1", 0.5, 0.4, None), ("a", "m2", 0.6, 0.3, None)],
                                  "config string, model string, balanced_acc double, macro_f1 double, cv_mean double")
    assert reports.best_per_config(board).first()["model"] == "m1"
    assert reports.cv_best_per_config(board).count() == 0
    assert reports.strongest_without_cv(board).first()["model"] == "m2"


def test_common_runs_need_every_config(spark):
    t = spark.createDataFrame([("a", "train", 1), ("b", "train", 1), ("a", "train", 2), ("b", "test", 2)],
                              "config string, split string, run_id bigint")
    assert [tuple(r) for r in sets.common_runs(t, 2).collect()] == [("train", 1)]


@pytest.mark.parametrize("per_bin", [1, 7, 65536])
def test_ranks_and_quantiles_with_ties_and_outliers(spark, per_bin):
    rng = np.random.RandomState(3)
    data = {"a": np.round(rng.normal(size=200), 1), "b": np.append(rng.normal(size=50), 1e12), "c": np.full(20, 3.0)}
    df = spark.createDataFrame([(k, float(v)) for k, x in data.items() for v in x], "feature string, value double")
    o = ordered_counts(value_counts(df, ["feature"]), ["feature"], per_bin=per_bin)
    for r in o.collect():
        x = data[r["feature"]]
        assert r["before"] == (x < r["value"]).sum() and r["n"] == (x == r["value"]).sum() and r["total"] == len(x)
    for r in quantiles(o, ["feature"], [0.0, 0.25, 0.5, 1.0]).collect():
        assert np.allclose(r["q"], np.quantile(data[r["feature"]], [0, 0.25, 0.5, 1]))


def test_mann_whitney_against_pairs(spark):
    rng = np.random.RandomState(4)
    label, value = rng.randint(0, 3, 60), np.round(rng.normal(size=60), 1)
    df = spark.createDataFrame([(i, int(c), "f", float(v)) for i, (c, v) in enumerate(zip(label, value))],
                               "run_id bigint, label int, feature string, value double")
    for r in ranking.mann_whitney(ranking.rank_sums(df, [0, 1, 2])).collect():
        a, b = value[label == r["label"]], value[label != r["label"]]
        assert r["u"] == sum((x > y) + 0.5 * (x == y) for x, y in itertools.product(a, b))


def test_fisher_exact_by_enumeration():
    for a, b, c, d in [(3, 1, 1, 3), (10, 2, 3, 15), (0, 5, 4, 1), (7, 7, 7, 7)]:
        row, col, n = a + b, a + c, a + b + c + d

        def p(k):
            return math.comb(row, k) * math.comb(n - row, col - k) / math.comb(n, col)

        ks = range(max(0, row + col - n), min(row, col) + 1)
        want = sum(p(k) for k in ks if p(k) <= p(a) * (1 + 1e-7))
        assert math.isclose(fisher_two_sided(a, b, c, d), want, rel_tol=1e-9)


def test_student_tail():
    assert math.isclose(student_two_sided(2.0, 10), 0.07338803, rel_tol=1e-6)
    assert math.isclose(student_two_sided(0.5, 3), 0.65145, rel_tol=1e-4)


def test_impute_range(spark):
    rows = [(1, "f", 1.0), (2, "f", float("nan")), (3, "f", float("inf")), (4, "f", float("-inf")), (5, "f", 4.0),
            (6, "f", 2.0), (7, "g", float("nan"))]
    df = spark.createDataFrame(rows, "run_id bigint, feature string, value double")
    got = {r["run_id"]: r["value"] for r in ranking.impute_range(df).collect()}
    assert got == {1: 1.0, 2: 2.0, 3: 4.0, 4: 1.0, 5: 4.0, 6: 2.0, 7: 0.0}


def test_only_features_with_missing_values_are_ordered_for_medians(spark, monkeypatch):
    ordered, asked = ranking.ordered_counts, []

    def noted(counts, *more, **options):
        asked.append({r["feature"] for r in counts.select("feature").distinct().collect()})
        return ordered(counts, *more, **options)

    monkeypatch.setattr(ranking, "ordered_counts", noted)
    rows = [(1, "whole", 1.0), (2, "whole", 3.0), (1, "ends", float("inf")), (2, "ends", 5.0), (3, "ends", 4.0), (1, "gaps", None),
            (2, "gaps", 1.0), (3, "gaps", 4.0), (1, "none", None), (2, "none", float("-inf"))]
    df = spark.createDataFrame(rows, "run_id bigint, feature string, value double")
    got = {(r["run_id"], r["feature"]): r["value"] for r in ranking.impute_range(df).collect()}
    assert got == {**{(i, f): v for i, f, v in rows}, (1, "ends"): 5.0, (1, "gaps"): 2.5, (1, "none"): 0.0, (2, "none"): 0.0}
    whole = df.where("feature = 'whole'")
    assert sorted(r["value"] for r in ranking.impute_range(whole).collect()) == [1.0, 3.0]
    assert asked == [{"gaps"}, set()]


def test_ranking_prefers_separating_features_and_drops_constants(spark):
    rng = np.random.RandomState(5)
    rows = []
    for i in range(90):
        c = i % 3
        rows += [(i, c, "good", float(c * 3 + rng.normal())), (i, c, "noise", float(rng.normal())), (i, c, "flat", 1.0)]
    df = spark.createDataFrame(rows, "run_id bigint, label int, feature string, value double")
    got = ranking.rank_features(df, [0, 1, 2]).collect()
    assert [r["feature"] for r in got] == ["good", "noise"]
    assert got[0]["n_significant"] >= 2 and got[0]["f_value"] > 50
    assert [r["feature"] for r in ranking.top_k_features(ranking.rank_features(df, [0, 1, 2]), 1).collect()] == ["good"]


def matrix(spark, n=120, seed=6):
    rng = np.random.RandomState(seed)
    rows = [(i, i % 3, [float(v) for v in rng.normal(size=4) + (i % 3) * 2]) for i in range(n)]
    return spark.createDataFrame(rows, "run_id bigint, label int, x array<double>")


def test_k_nearest_by_brute_force(spark):
    m = matrix(spark)
    train, test = m.where("run_id % 4 > 0"), m.where("run_id % 4 = 0")
    got = {r["run_id"]: r["y_pred"] for r in baselines.k_nearest(train, test, 5, tile=16).collect()}
    tr = train.orderBy("run_id").toPandas()
    x = np.stack(tr["x"])
    for r in test.collect():
        near = np.lexsort((tr["run_id"], ((x - np.array(r["x"])) ** 2).sum(1)))[:5]
        votes = np.bincount(tr["label"].to_numpy()[near], minlength=3)
        assert got[r["run_id"]] == votes.argmax()


def test_models_learn_and_folds_are_balanced(spark):
    m = matrix(spark).withColumn("split", F.lit("train"))
    folds = models.fold_column(m, 4, block=10).groupBy("label", "fold").count().collect()
    assert len(folds) == 12 and all(r["count"] == 10 for r in folds)
    train, test = m.where("run_id % 4 > 0"), m.where("run_id % 4 = 0")
    pred, board = models.compare_models(train, test, [0, 1, 2], "c", ["RandomForestClassifier", "MajorityClassifier"],
                                        cv_folds=2, trees=10)
    got = {r["model"]: r for r in board.collect()}
    assert got["RandomForestClassifier"]["balanced_acc"] > 0.8 > got["MajorityClassifier"]["balanced_acc"]
    assert got["RandomForestClassifier"]["cv_mean"] > 0.7
    assert pred.count() == 2 * test.count()


def test_one_vs_rest_models(spark):
    m = matrix(spark)
    got = models.fit_predict(m, m, models.zoo(4, 3)["LinearSVC"])
    assert got.where("y_true = y_pred").count() > 80


def test_k_nearest_with_many_equal_rows(spark):
    """200 equal training rows, ids 0..4 of class 0: the five smallest ids vote."""
    rows = [(i, int(i > 4), [1.0, 1.0]) for i in range(200)] + [(300 + i, 2, [1.0, 1.0 + i]) for i in range(1, 40)]
    train = spark.createDataFrame(rows, "run_id bigint, label int, x array<double>")
    test = spark.createDataFrame([(900, 0, [1.0, 1.0]), (901, 2, [1.0, 30.0]), (902, 0, [1.0, 1.5])], train.schema)
    got = {r["run_id"]: r["y_pred"] for r in baselines.k_nearest(train, test, 5, tile=8).collect()}
    assert got == {900: 0, 901: 2, 902: 0}
    near = neighbours.nearest_rows(train, test, 3, tile=8).where("run_id = 902").orderBy("place").collect()
    assert [r["near"] for r in near] == [0, 1, 2]


def test_k_nearest_prunes_cells_and_stays_exact(spark):
    rng = np.random.RandomState(3)
    centres = rng.normal(size=(30, 3)) * 50
    rows = [(i, i % 4, [float(v) for v in np.round(centres[i % 30] + rng.normal(size=3), 1)]) for i in range(900)]
    train = spark.createDataFrame(rows, "run_id bigint, label int, x array<double>")
    test = train.where("run_id % 9 = 0").withColumn("run_id", F.col("run_id") + 10000)
    x = np.array([r[2] for r in rows])
    got = neighbours.nearest_rows(train, test, 4, tile=16).collect()
    for r in test.collect():
        d = ((x - np.array(r["x"])) ** 2).sum(1)
        want = np.lexsort((np.arange(900), d))[:4]
        mine = sorted((g["place"], g["near"], g["dist"]) for g in got if g["run_id"] == r["run_id"])
        assert [m[1] for m in mine] == want.tolist() and np.allclose([m[2] for m in mine], d[want])
    cells = neighbours.Cells(x[:30], np.full(30, 30), np.full(30, 6.0))
    assert len(cells.reached(x[0], 3.0)) < 5 and len(cells.first(x[0], 61)) == 3
    none = train.where("run_id < 0")
    assert neighbours.nearest_rows(none, test, 4).count() == 0 and neighbours.nearest_rows(train, none, 4).count() == 0


def test_discriminants_by_closed_form(spark):
    rng = np.random.RandomState(8)
    n, width = 240, 3
    label = np.arange(n) % 3
    x = rng.normal(size=(n, width)) * (1 + label[:, None]) + label[:, None] * [2.0, -1.0, 0.5]
    m = spark.createDataFrame([(i, int(c), [float(v) for v in r]) for i, (c, r) in enumerate(zip(label, x))],
                              "run_id bigint, label int, x array<double>")
    fold = np.arange(n) // 3 % 4  # position within the class modulo the folds

    def scores(train, quadratic):
        parts = [x[train & (label == c)] for c in range(3)]
        pooled = sum(np.cov(p.T, bias=True) * len(p) for p in parts) / (train.sum() - 3)
        out = []
        for p in parts:
            cov = np.cov(p.T) if quadratic else pooled
            gap = x - p.mean(0)
            out.append((gap @ np.linalg.inv(cov) * gap).sum(1) + (np.log(np.linalg.det(cov)) if quadratic else 0)
                       - 2 * np.log(len(p) / train.sum()))
        return np.argmin(out, axis=0)

    for fit, quadratic in ((discriminants.linear_discriminant, False), (discriminants.quadratic_discriminant, True)):
        got = {r["run_id"]: r["y_pred"] for r in fit(m.where("run_id < 150"), m.where("run_id >= 150")).collect()}
        want = scores(np.arange(n) < 150, quadratic)
        assert got == {i: want[i] for i in range(150, n)}
        rows = fit.by_folds(models.fold_column(m, 4), 4).collect()
        assert len(rows) == n
        for f in range(4):
            want = scores(fold != f, quadratic)
            assert all(r["y_pred"] == want[r["run_id"]] for r in rows if r["fold"] == f) and \
                {r["run_id"] for r in rows if r["fold"] == f} == set(np.flatnonzero(fold == f))


def test_folds_by_subtraction_equal_refitting(spark):
    m = matrix(spark, 150).where("label < 2 or run_id % 4 = 2")
    folded = models.fold_column(m, 5).cache()
    wide = folded.withColumn("x", F.flatten(F.array_repeat("x", 300)))  # more features than one chunk
    for fit, rows in ((baselines.nearest_centroid, folded), (baselines.gaussian_nb, folded), (baselines.majority_baseline, folded),
                      (baselines.nearest_centroid, wide)):
        got = {r["run_id"]: r["y_pred"] for r in fit.by_folds(rows, 5).collect()}
        assert len(got) == folded.count()
        for f in range(5):
            one = fit(rows.where(F.col("fold") != f), rows.where(F.col("fold") == f)).collect()
            assert all(got[r["run_id"]] == r["y_pred"] for r in one) and one


def test_a_class_inside_one_fold_is_not_learnt_there(spark):
    m = matrix(spark, 60)
    folded = m.withColumn("fold", F.when(F.col("label") == 2, 1).otherwise((F.col("run_id") % 2).cast("int")))
    for fit in (baselines.nearest_centroid, baselines.gaussian_nb, discriminants.linear_discriminant):
        rows = fit.by_folds(folded, 2).collect()
        assert len(rows) == 60 and {r["y_pred"] for r in rows if r["fold"] == 1} <= {0, 1}


def test_large_models_are_joined_by_salt(spark, monkeypatch):
    m = matrix(spark, 90)
    train, test = m.where("run_id % 3 > 0"), m.where("run_id % 3 = 0")
    small = {r["run_id"]: r["y_pred"] for r in baselines.nearest_centroid(train, test).collect()}
    monkeypatch.setattr(baselines, "BROADCAST_NUMBERS", 0)
    assert small == {r["run_id"]: r["y_pred"] for r in baselines.nearest_centroid(train, test).collect()} and len(small) == 30


def test_ranges_and_tasks_of_an_ordering(spark):
    """Ranges hold at most per_bin values, and small ranges do not make as many tasks."""
    df = spark.range(20000).select((F.col("id") % 3).cast("string").alias("feature"), F.exp(F.col("id") / 100.0).alias("value"))
    o = ordered_counts(value_counts(df, ["feature"]), ["feature"], per_bin=10, keep_range=True)
    assert o.groupBy("range").count().agg(F.max("count"), F.count("*")).first()[0] <= 10
    assert o.agg(F.sum("n")).first()[0] == 20000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        o = ordered_counts(value_counts(df, ["feature"]), ["feature"], per_bin=10)
        assert o.select(F.spark_partition_id()).distinct().count() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
        for r in o.groupBy("feature").agg(F.min("before").alias("lo"), F.max("before").alias("hi"), F.max("total").alias("t"),
                                          F.countDistinct("before").alias("k")).collect():
            assert (r["lo"], r["hi"], r["k"]) == (0, r["t"] - 1, r["t"])
        for r in quantiles(o, ["feature"], [0.0, 0.5, 1.0]).collect():
            x = np.exp(np.arange(int(r["feature"]), 20000, 3) / 100.0)
            assert np.allclose(r["q"], np.quantile(x, [0, 0.5, 1]))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_scores_of_a_board_read_predictions_once_and_join_no_class_tables(spark):
    seen = spark.sparkContext.accumulator(0)
    rows = [(i, i % 3, (i + (i % 5 == 0)) % 3, "all", m) for m in ("a", "b") for i in range(30)] + [(1, 0, None, "all", "gap"), (2, 7, 7, "all", "a")]
    df = spark.createDataFrame(rows, "run_id bigint, y_true int, y_pred int, config string, model string")

    def passing(frames):
        for pdf in frames:
            seen.add(len(pdf))
            yield pdf

    cv = spark.createDataFrame([("all", m, 0.5, 0.1) for m in ("a", "b", "gap")], "config string, model string, cv_mean double, cv_std double")
    board = models.summary_rows(df.mapInPandas(passing, df.schema), cv, [0, 1, 2])
    got = {r["model"]: r for r in board.collect()}
    assert seen.value == len(rows)
    assert {m: r["status"] for m, r in got.items()} == {"a": "ok", "b": "ok", "gap": "incomplete"}
    assert math.isclose(got["a"]["balanced_acc"], 0.8) and got["a"]["macro_f1"] == got["b"]["macro_f1"]
    cm = metrics.confusion_counts(df.where("model = 'a'"), [0, 1, 2])
    assert cm.count() == 9 and cm.agg({"n": "sum"}).first()[0] == 30
    assert "Join" not in metrics.scores(cm)._jdf.queryExecution().optimizedPlan().toString()


def test_models_are_fitted_side_by_side(spark, monkeypatch):
    """Each of two models waits until the other one is being fitted; their rows and a failed model keep their own results."""
    rows = [(i, i % 2, [float(i % 2), float(i)]) for i in range(20)]
    train = spark.createDataFrame(rows, "run_id bigint, label int, x array<double>")
    meeting = threading.Barrier(2, timeout=20)

    def model(right):
        def fit(train, test):
            meeting.wait()
            return test.select("run_id", F.col("label").alias("y_true"), (F.col("label") if right else 1 - F.col("label")).alias("y_pred"))
        return fit

    def broken(train, test):
        raise ValueError("not today")

    monkeypatch.setattr(models, "PLAIN_MODELS", {"good": model(True), "bad": model(False), "broken": broken})
    board = {r["model"]: r for r in models.compare_models(train, train, [0, 1], "c", ["good", "bad", "broken"], cv_folds=0)[1].collect()}
    assert {m: (r["status"], r["balanced_acc"]) for m, r in board.items()} == {"good": ("ok", 1.0), "bad": ("ok", 0.0), "broken": ("failed", None)}
    assert board["broken"]["error"] == "ValueError: not today"


def test_k_nearest_returns_few_rows_where_all_cells_are_asked(spark, monkeypatch):
    """In 16 dimensions nearly every cell is asked; packs give back what lies within the bound, not k rows of every small tile."""
    rng = np.random.RandomState(8)
    x = rng.normal(size=(500, 16))
    rows = spark.createDataFrame([(i, i % 3, [float(v) for v in x[i]]) for i in range(500)], "run_id bigint, label int, x array<double>")
    seen, visit = [], neighbours.visit
    monkeypatch.setattr(neighbours, "visit", lambda *a: seen.append(visit(*a).cache()) or seen[-1])
    got = {(r["run_id"], r["place"]): r["near"] for r in neighbours.nearest_rows(rows.where("run_id >= 100"), rows.where("run_id < 100"), 3, tile=8).collect()}
    for i in range(100):
        want = 100 + np.lexsort((np.arange(400), ((x[100:] - x[i]) ** 2).sum(1)))[:3]
        assert [got[i, place] for place in (1, 2, 3)] == want.tolist()
    assert sum(df.count() for df in seen) < 100 * 3 * 8  # 100 * 3 * 50 with a group of its own for every tile


def test_packs_hold_all_cells_and_no_more_than_their_rows():
    rng = np.random.RandomState(5)
    cells = neighbours.Cells(rng.normal(size=(40, 2)), rng.randint(0, 30, 40), np.ones(40))
    pack = cells.packs(60)
    held = np.bincount(pack, weights=cells.sizes)
    assert len(pack) == 40 and held.max() <= 60 and len(held) < 40 and cells.packs(1).max() > len(held) - 1


def test_deep_trees_keep_node_numbers_and_stay_the_same(spark, monkeypatch):
    m = matrix(spark).withColumn("label", F.expr("cast(pmod(xxhash64(run_id), 3) as int)")).coalesce(1)
    assert all(models.zoo(4, 3)[name].getCacheNodeIds() for name in ("RandomForestClassifier", "DecisionTreeClassifier"))
    built, forest = [], models.RandomForestClassifier
    monkeypatch.setattr(models, "RandomForestClassifier", lambda **kw: built.append(forest(**kw)) or built[-1])
    got = sorted(map(tuple, models.random_forest(m, m, trees=5).collect()))
    monkeypatch.setattr(models, "DEEP", {})
    assert got == sorted(map(tuple, models.random_forest(m, m, trees=5).collect()))
    assert [e.getCacheNodeIds() for e in built] == [True, False]


def test_ranks_move_packed_values_in_ranges_of_any_size(spark):
    """Features without anything to fill in are not joined, and ranks do not depend on how values are cut into ranges."""
    rng = np.random.RandomState(3)
    rows = [(i, int(rng.randint(4)) if i % 9 else None, f, v) for i in range(300)
            for f, v in (("a", float(rng.normal())), ("b", float(rng.randint(6))), ("c", -0.0 if i % 2 else 0.0),
                         ("d", [None, float("nan"), float("inf"), 2.0, -1.5][i % 5]))]
    long = spark.createDataFrame(rows, "run_id bigint, label int, feature string, value double")
    plain = ranking.impute_range(long.where("feature < 'd'"))
    assert "Join" not in plain._jdf.queryExecution().optimizedPlan().toString() and plain.count() == 900
    one = {(r["feature"], r["label"]): tuple(r) for r in ranking.rank_sums(long, [0, 1, 2, 3]).collect()}
    many = {(r["feature"], r["label"]): tuple(r) for r in ranking.rank_sums(long, [0, 1, 2, 3], most=40).collect()}
    assert one == many and len(one) == 16
    for f in "abcd":
        got = [(-np.inf if v is None else 1e308 if v != v else 1e307 if v == np.inf else v, lab) for _, lab, g, v in rows if g == f]
        values = np.array([v for v, _ in got])
        ranks = np.array([(values < v).sum() + ((values == v).sum() + 1) / 2 for v in values])
        seen = np.unique(values, return_counts=True)[1].astype(float)
        for c in range(4):
            mine = np.array([lab == c for _, lab in got])
            low = values == values.min()
            assert one[f, c] == (f, 300, (seen ** 3 - seen).sum(), len(seen), low.sum(), c, mine.sum(), ranks[mine].sum(), (mine & low).sum())
