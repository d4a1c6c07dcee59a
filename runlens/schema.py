"""Names, fixed values and configuration objects shared by every operator."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import types as T

FAULT, RUN, SAMPLE = "faultNumber", "simulationRun", "sample"
KEYS = [FAULT, RUN]

# Fixed values of the public process data set: 41 measurements, 11 actuators,
# fault classes 0..20, first post-fault sample per split.
XMEAS = [f"xmeas_{i}" for i in range(1, 42)]
XMV = [f"xmv_{i}" for i in range(1, 12)]
CHANNELS = XMEAS + XMV
LABELS = list(range(21))
CUTOFF = {"train": 21, "test": 161}
FILES = {
    "train": ("TEP_FaultFree_Training.csv", "TEP_Faulty_Training.csv"),
    "test": ("TEP_FaultFree_Testing.csv", "TEP_Faulty_Testing.csv"),
}
SCALING_MODES = ("global_mean", "scaler")
FEATURE_SETS = ("minimal", "efficient", "additive", "comprehensive")

# Samples of one run that may meet in one task. Longer runs are cut into blocks of this size
# (a multiple of 50, so that chunk features never straddle a border).
BLOCK = 4000


def sample_schema(channels=CHANNELS) -> T.StructType:
    """Explicit reader schema: three integer keys and one double per channel."""
    meta = [T.StructField(c, T.IntegerType()) for c in (FAULT, RUN, SAMPLE)]
    return T.StructType(meta + [T.StructField(c, T.DoubleType()) for c in channels])


@dataclass(frozen=True)
class Window:
    """Samples of a run that take part: faulty runs from ``start`` on, then at most so many of normal and faulty runs."""

    start: int = CUTOFF["train"]
    normal: int | None = None
    faulty: int | None = None


#: Window of the test split: its faults set in later, and runs are cut to the length of training runs.
TEST_WINDOW = Window(CUTOFF["test"], 500, 480)


@dataclass(frozen=True)
class Numerics:
    """Parameters of the decompositions, whatever job they serve."""

    lags: int = 2
    past: int = 1
    future: int = 1
    ridge: float = 1e-6
    linear: int = 2
    total: int = 4
    components: int = 12
    steps: int = 1000
    tolerance: float = 1e-3
    seed: int = 42


def known(value, values, what: str) -> None:
    if value not in values:
        raise ValueError(f"unknown {what} {value!r}")


@dataclass(frozen=True)
class SpectrumConfig:
    """One characterisation job: a method on the windows of all runs."""

    method: str
    window: Window = Window()
    numerics: Numerics = Numerics()
    scaling_mode: str = "global_mean"
    runs: int | None = None
    strict: bool = False
    block: int = BLOCK

    def __post_init__(self):
        known(self.scaling_mode, SCALING_MODES, "scaling mode")

    def over(self, window: Window) -> "SpectrumConfig":
        """The same job on other windows."""
        return replace(self, window=window)


@dataclass(frozen=True)
class Ranking:
    """Choice of features: how many, and the false-discovery control behind the order (level, dependent form, features
    per corrected block or None for all at once)."""

    top_k: int = 100
    alpha: float = 0.05
    dependent: bool = True
    block: int | None = 4000


@dataclass(frozen=True)
class Learning:
    """Model comparison: folds, deepest trees (pyspark.ml grows 30 levels at most), seed, and whether all configs are compared on
    the runs they have in common."""

    folds: int = 5
    depth: int = 30
    seed: int = 42
    common_runs: bool = True


@dataclass(frozen=True)
class PipelineConfig:
    """One feature-classification study over projections (``configs``)."""

    configs: tuple
    scaling_mode: str = "global_mean"
    runs: int | None = None
    run_length: int | None = 480
    uniform: bool = True
    fix_signs: bool = True
    feature_set: str = "additive"
    numerics: Numerics = Numerics()
    ranking: Ranking = Ranking()
    learning: Learning = Learning()
    labels: tuple = field(default_factory=lambda: tuple(LABELS))
    block: int = BLOCK

    def __post_init__(self):
        known(self.scaling_mode, SCALING_MODES, "scaling mode")
        known(self.feature_set, FEATURE_SETS, "feature set")

    def quick(self) -> "PipelineConfig":
        """A small trial of the same study."""
        return replace(self, runs=4, feature_set="minimal", ranking=replace(self.ranking, top_k=20))


def fingerprint(cfg, **extra) -> str:
    """Short hash over every parameter; names stored results so that no parameter can be forgotten."""
    body = asdict(cfg) if hasattr(cfg, "__dataclass_fields__") else dict(cfg)
    text = json.dumps({**body, **extra}, sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:16]
