"""The feature study: project, extract, rank and keep top-K (A), extract those on test (B), compare models (C).

Every phase stores its tables under a name made of all parameters, so a repeated call reads them back.
What reaches the driver is K feature names per config and the leaderboard.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, metrics, models, prep, projections, ranking, reports, sets, windows
from ..schema import CHANNELS, KEYS, PipelineConfig
from ..session import release, side_by_side
from ..sources import store
from ..sources.runs import prepare_runs


class Study:
    """One study over ``cfg.configs``.

    ``read`` maps "train"/"test" to samples (keys, sample, x); it is called only for what is not stored.
    Extraction runs in waves of ``per_wave`` out of ``buckets`` run buckets and resumes after an interruption.
    """

    def __init__(self, spark: SparkSession, cfg: PipelineConfig, read: Callable[[str], DataFrame], base: str,
                 channels=tuple(CHANNELS), cutoff: dict | None = None, dense: bool = False, buckets: int = 16,
                 per_wave: int = 4):
        self.spark, self.cfg, self.read, self.base = spark, cfg, read, base
        self.buckets, self.per_wave = buckets, per_wave
        self.channels, self.cutoff, self.dense = list(channels), cutoff, dense
        self.names = projections.validate(cfg.configs)
        self.scaler = prep.fit_scaler(read("train")) if cfg.scaling_mode == "scaler" else None
        self.preparing = threading.Lock()
        self.context = projections.Context(cfg, len(self.channels), self.scaler, tuple(channels))

    def _specs(self):
        return list(zip(self.cfg.configs, self.names))

    def _samples(self, name: str, split: str) -> str:
        return f"{self.base}/{name}/{store.fingerprint(self.cfg, split=split, cutoff=self.cutoff, dense=self.dense)}"

    def _rows(self, split: str) -> DataFrame:
        """Prepared samples of a split, stored until all configs are extracted from them.

        Reading, numbering and cutting move all samples: each is done once for all configs, one after the other, and its shuffle
        files go before the next begins."""
        with self.preparing:
            ready, given = self._samples("samples", split), self._samples("read", split)
            if not store.stored(self.spark, ready):
                if not store.stored(self.spark, given):
                    prep.first_runs(self.read(split), self.cfg.runs).write.mode("overwrite").parquet(given)
                    release(self.spark)
                prepare_runs(self.spark.read.parquet(given), split, self.cutoff[split] if self.cutoff else None, self.cfg.uniform,
                             self.cfg.run_length, self.dense, self.cfg.block).write.mode("overwrite").parquet(ready)
                store.drop(self.spark, given)
                release(self.spark)
        return windows.unplaced(self.spark.read.parquet(ready))

    def _long_runs(self):
        length = self.cfg.run_length
        return False if length is not None and length <= self.cfg.block else None

    def _tag(self, long: DataFrame, split: str) -> DataFrame:
        return long.select(prep.run_key().alias("run_id"), F.col(KEYS[0]).alias("label"),
                           F.lit(split).alias("split"), "feature", "value")

    def _extract(self, spec, name, split: str, how: Callable, **extra) -> DataFrame:
        channels = projections.channel_names(spec, self.channels)

        def projected():
            return projections.project(self._rows(split), spec, self.context, stored=True)

        path = f"{self.base}/features/{store.fingerprint(self.cfg, config=name, split=split, **extra)}"
        return self._tag(store.extract_resumable(self.spark, projected, path, lambda rows: how(rows, channels), self.buckets,
                                                 self.per_wave), split)

    def train_features(self, spec, name) -> DataFrame:
        """All features of the training runs, stored."""
        return self._extract(spec, name, "train", lambda rows, channels: features.extract_features(
            rows, channels, self.cfg.feature_set, block=self.cfg.block, long_runs=self._long_runs()))

    def rank(self, spec, name) -> DataFrame:
        def build():
            return ranking.rank_features(self.train_features(spec, name), self.cfg.labels, self.cfg.ranking.alpha,
                                         self.cfg.ranking.dependent, self.cfg.ranking.block)
        return store.materialise(self.spark, self.base, "rank", self.cfg, build, config=name)

    def top_names(self, spec, name) -> list:
        """The K best feature names of a config, best first."""
        rows = ranking.top_k_features(self.rank(spec, name), self.cfg.ranking.top_k).orderBy("place").select("feature").collect()
        return [r["feature"] for r in rows]

    def test_features(self, spec, name, wanted) -> DataFrame:
        """Only the selected features, on the test runs, stored."""
        return self._extract(spec, name, "test", lambda rows, channels: features.extract_selected(
            rows, channels, wanted, block=self.cfg.block, long_runs=self._long_runs()), names=sorted(wanted))

    def matrices(self) -> dict:
        """{config: (train, test)} as feature arrays over the runs common to all configs."""
        def both(one):
            spec, name = one
            wanted = self.top_names(spec, name)
            if not wanted:
                raise RuntimeError(f"no feature of {name!r} separates any classes")
            return tuple(models.feature_matrix(df, wanted) for df in (
                self.train_features(spec, name), self.test_features(spec, name, wanted)))

        # Configs share nothing before their common runs.
        parts = dict(zip(self.names, side_by_side(self.spark, both, self._specs())))
        for split in ("train", "test"):
            store.drop(self.spark, self._samples("samples", split))
        release(self.spark)
        if not self.cfg.learning.common_runs:
            return parts
        seen = reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("config"), "split", "run_id")
                                              for n, both in parts.items() for df in both])
        common = sets.common_runs(seen, len(parts))
        return {n: tuple(sets.restrict(df, common) for df in both) for n, both in parts.items()}

    def summary(self, names=None, trees: int = 100) -> DataFrame:
        """Leaderboard of configs and models, stored."""
        def build():
            def board(one):
                n, (tr, te) = one
                return models.compare_models(tr, te, self.cfg.labels, n, names, self.cfg.learning.folds,
                                             self.cfg.learning.seed, trees, self.cfg.learning.depth)[1]
            return reduce(DataFrame.unionByName, side_by_side(self.spark, board, self.matrices().items()))
        return store.materialise(self.spark, self.base, "summary", self.cfg, build, models=names, trees=trees)

    def compare(self, names=None, trees: int = 100) -> dict:
        """Fixed model, test-selected and cv-selected views with the gap between the last two."""
        board = self.summary(names, trees)
        return {"main": reports.fixed_model_view(board, self.names),
                "best_per_config": reports.in_order(reports.best_per_config(board), self.names),
                "cv_best": reports.in_order(reports.cv_best_per_config(board), self.names),
                "gap": reports.cv_gap(board)}

    def predictions(self, refit: bool = False, estimator=None, trees: int = 100) -> DataFrame:
        """Predictions of one model type for every config, stored; ``refit`` computes them again."""
        def build():
            parts = []
            for n, (tr, te) in self.matrices().items():
                got = (models.random_forest(tr, te, self.cfg.learning.seed, trees, self.cfg.learning.depth) if estimator is None
                       else models.fit_predict(tr, te, estimator))
                parts.append(got.withColumn("config", F.lit(n)))
            return reduce(DataFrame.unionByName, parts)
        return store.materialise(self.spark, self.base, "predictions", self.cfg, build, refit, trees=trees,
                                 estimator=repr(estimator))

    def confusion(self, refit: bool = False, estimator=None, trees: int = 100) -> tuple:
        """(confusion counts, scores per config with the numbers of features and training runs behind them)."""
        cm = metrics.confusion_counts(self.predictions(refit, estimator, trees), self.cfg.labels)
        return cm, metrics.scores(cm).join(self.model_sizes(), "config")

    def model_sizes(self) -> DataFrame:
        """Per config the number of features and of training runs, stored."""
        def build():
            names = dict((name, spec) for spec, name in self._specs())
            parts = [tr.agg(F.lit(n).alias("config"), F.lit(len(self.top_names(names[n], n))).alias("n_features"),
                            F.count(F.lit(1)).alias("n_train")) for n, (tr, _) in self.matrices().items()]
            return reduce(DataFrame.unionByName, parts)
        return store.materialise(self.spark, self.base, "sizes", self.cfg, build)
