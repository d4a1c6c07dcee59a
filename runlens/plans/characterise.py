"""Spectra per run, statistics per class, and classification on spectra."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics, models, prep, reports, sets, spectra
from ..schema import KEYS, LABELS, TEST_WINDOW, SpectrumConfig, Window
from ..session import cut_lineage
from ..sources import store


def needs_scaler(cfgs) -> bool:
    return any(c.scaling_mode == "scaler" or spectra.method(c.method).scaling == "scaler" for c in cfgs)


def characterise(df: DataFrame, cfg: SpectrumConfig, width: int, scaler=None, dense: bool = False) -> tuple:
    """(spectra, class statistics). The scaler is fitted on fault-free rows when the job needs one.

    The spectra, one row per run, are stored once: the check for success, their statistics and whoever writes them read the same rows."""
    if scaler is None and needs_scaler([cfg]):
        scaler = prep.fit_scaler(df)
    per_run = cut_lineage(spectra.run_spectra(df, cfg, width, scaler, dense))
    spectra.require_success(per_run, strict=cfg.strict)
    return per_run, reports.aggregate_spectra(per_run.where("status = 'ok'"))


def spectra_sets(spark, base: str, cfgs: list, test_df, width: int, window: Window = TEST_WINDOW, scaler=None,
                 dense: bool = False) -> dict:
    """{label: (train, test)}: stored training spectra, and test spectra computed unless stored.

    ``test_df`` is a function, so the test samples are only read when something has to be computed; ``window`` says
    which of them take part.
    """
    out = {}
    for cfg in cfgs:
        def build(cfg=cfg):
            return spectra.run_spectra(test_df(), cfg.over(window), width, scaler, dense)
        train = store.read_spectra(spark, base, cfg, "train").where("status = 'ok'")
        test = store.spectra_or_build(spark, base, cfg.over(window), "test", build).where("status = 'ok'")
        out[spectra.method(cfg.method).export.label] = (train, test)
    return out


def combine(pairs: dict) -> dict:
    """Add the inner join of all sets under the name A+B."""
    if len(pairs) < 2:
        return dict(pairs)
    name = "+".join(pairs)
    return {**pairs, name: (sets.combine_feature_sets([tr for tr, _ in pairs.values()]),
                            sets.combine_feature_sets([te for _, te in pairs.values()]))}


def as_matrix(spectrum: DataFrame) -> DataFrame:
    """Spectrum rows as model input."""
    return spectrum.select(prep.run_key().alias("run_id"), F.col(KEYS[0]).alias("label"),
                           F.transform("values", lambda v: prep.nan_to_zero(v)).alias("x"))


def classify_spectra(pairs: dict, labels=LABELS, names=None, cv_folds: int = 5, seed: int = 42, trees: int = 100,
                     depth: int = 30):
    """Model comparison and random-forest confusion counts for every feature set."""
    summaries, preds = [], []
    for config, (train, test) in pairs.items():
        tr, te = as_matrix(train), as_matrix(test)
        _, summary = models.compare_models(tr, te, labels, config, names, cv_folds, seed, trees, depth)
        summaries.append(summary)
        preds.append(models.random_forest(tr, te, seed, trees, depth).withColumn("config", F.lit(config)))
    board = reports.sort_leaderboard(reduce(DataFrame.unionByName, summaries))
    return board, metrics.confusion_counts(reduce(DataFrame.unionByName, preds), labels)


def distribution(pairs: dict) -> DataFrame:
    """Runs per class and set, with the losses against the first set."""
    rows = [t.select("faultNumber", F.lit(name).alias("config"), F.lit(split).alias("split"))
            for name, both in pairs.items() for split, t in zip(("train", "test"), both)]
    return sets.class_distribution(reduce(DataFrame.unionByName, rows), list(pairs))
