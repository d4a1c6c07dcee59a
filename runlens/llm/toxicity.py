"""Toxicity grades by cumulative-link ordinal regression on sparse word features.

P(grade <= k) = sigmoid(theta_k - w x): one weight per word shared by all ordered thresholds theta_1 < theta_2 < .. The output is
the expected grade, sum of P(grade > k).

Training data. Labels say toxic or not; toxic rows are graded 1..3 by terciles of how many markers they hold (markers:
features whose share among toxic rows exceeds that among clean rows by `z_least` standard errors). The fit uses a bounded sample:
at most `per_class` labelled documents of either kind, those with the smallest MD5 of seed and id. Word statistics are
Spark aggregations over the sample; the driver receives at most `vocabulary` features and the sample's sparse vectors over
them. Scoring covers every document and its whole text.

Features: how often each word and each word beginning of 3, 4 and 6 characters of the vocabulary occurs in the lower-cased
text, divided by sqrt(1 + words / 200), so that a stray word in a long text weighs little; words are runs of letters,
digits and characters outside ASCII. Beginnings stand for inflected forms.

Defined cases: null text has no words and gets the grade of the empty text; null labels are not used; rows repeated with one
id count once as label (toxic wins) and are scored alike; null ids match no label; without rows of both kinds no word has a
weight and all severities are 0; an empty table gives an empty result; other columns pass through `grade_texts`.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import FOLD, extended, mapped, slices, stored, table

SEED = 23


@dataclass
class Ordinal:
    """Words, their weights, and the ordered thresholds (none: every severity is 0)."""

    words: list[str]
    weights: list[float]
    thresholds: list[float]


#: Lengths of the word beginnings that are features.
STARTS = (3, 4, 6)


def tokens(text: str) -> list[str]:
    return text.lower().encode().translate(FOLD).decode().split()


def features(words: Counter) -> Counter:
    """Counts of whole words ("word$") and of their beginnings."""
    out: Counter = Counter()
    for word, n in words.items():
        out[word + "$"] += n
        for k in STARTS:
            if len(word) >= k:
                out[word[:k]] += n
    return out


def damping(n_words: int) -> float:
    return 1 / math.sqrt(1 + n_words / 200)


def fit_ordinal(x: np.ndarray, y: np.ndarray, levels: int, l2: float = 1e-3, steps: int = 400, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by Adam on the mean log-likelihood; thresholds are a first one and positive gaps."""
    n, d = x.shape
    w, free = np.zeros(d), np.concatenate([[0.0], np.full(levels - 2, 0.0)])
    m, v = np.zeros(d + levels - 1), np.zeros(d + levels - 1)
    sigmoid = lambda t: 1 / (1 + np.exp(-np.clip(t, -40, 40)))
    for step in range(1, steps + 1):
        gaps = np.exp(free[1:])
        theta = free[0] + np.concatenate([[0.0], np.cumsum(gaps)])
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        z = x @ w
        hi, lo = edge[y + 1] - z, edge[y] - z
        s_hi, s_lo = sigmoid(hi), sigmoid(lo)
        p = np.maximum(s_hi - s_lo, 1e-12)
        d_hi, d_lo = s_hi * (1 - s_hi) / p, s_lo * (1 - s_lo) / p
        g_w = x.T @ (d_lo - d_hi) / n - l2 * w
        g_theta = np.array([d_hi[y == k].sum() - d_lo[y == k + 1].sum() for k in range(levels - 1)]) / n
        g_free = np.concatenate([[g_theta.sum()], np.cumsum(g_theta[::-1])[::-1][1:] * gaps])
        g = np.concatenate([g_w, g_free])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, free = w + move[:d], free + move[d:]
    return w, free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])


def sample(docs: DataFrame, labels: DataFrame, per_class: int, id_col: str, text_col: str, seed: int) -> DataFrame:
    """(doc_id, toxic, text) of at most `per_class` labelled documents of either kind."""
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .withColumn("draw", F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")))))
    some = [known.where(F.col("toxic") == kind).orderBy("draw", "doc_id").limit(per_class) for kind in (0, 1)]
    ids = some[0].unionByName(some[1]).select(F.col("doc_id").alias("__id"), "toxic")
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    # At most 2 * per_class narrow rows: the parameter bounds what is broadcast.
    return rows.join(F.broadcast(ids), "__id")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000, vocabulary: int = 512, z_least: float = 6.0,
        least_docs: int = 5, levels: int = 4, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> Ordinal:
    import pyarrow as pa

    chosen = sample(docs, labels, per_class, id_col, text_col, seed).select("toxic", "text")

    def bags(batches):
        for batch in batches:
            for part in slices(batch):
                words = [tokens(t or "") for t in part.column(1).to_pylist()]
                found = [sorted(features(Counter(w)).items()) for w in words]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int32()), pa.array([[w for w, _ in b] for b in found], pa.list_(pa.string())),
                     pa.array([[c * damping(len(w)) for _, c in b] for b, w in zip(found, words)], pa.list_(pa.float64())),
                     pa.array([[c for _, c in b] for b in found], pa.list_(pa.int64()))],
                    names=["toxic", "words", "values", "counts"])

    # Three jobs read them; texts are read and cut into words once.
    rows = stored(mapped(chosen, bags, "toxic int, words array<string>, values array<double>, counts array<long>"), "toxicity-sample",
                  2 * per_class, per_file=512)
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return Ordinal([], [], [])
    a, b = F.sum(F.col("toxic")), F.sum(1 - F.col("toxic"))
    spread = F.sqrt((F.col("a") + F.col("b")) / (n0 + n1) * (1 / n0 + 1 / n1))
    best = (rows.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(a.alias("a"), b.alias("b"))
            .where(F.col("a") + F.col("b") >= least_docs)
            .withColumn("z", (F.col("a") / n1 - F.col("b") / n0) / spread)
            .orderBy(F.abs("z").desc(), "word").limit(vocabulary).collect())
    words = sorted(r["word"] for r in best if abs(r["z"]) >= z_least)
    markers = {r["word"] for r in best if r["z"] >= z_least}
    if not words:
        return Ordinal([], [], [])
    at = {w: i for i, w in enumerate(words)}

    def vectors(batches):
        for batch in batches:
            kept = []
            for toxic, ws, vs, cs in zip(*(batch.column(i).to_pylist() for i in range(4))):
                hits = [(at[w], v) for w, v in zip(ws, vs) if w in at]
                kept.append({"toxic": toxic, "i": [i for i, _ in hits], "v": [v for _, v in hits],
                             "m": sum(c for w, c in zip(ws, cs) if w in markers)})
            yield pa.RecordBatch.from_pylist(kept, schema=pa.schema([
                ("toxic", pa.int32()), ("i", pa.list_(pa.int32())), ("v", pa.list_(pa.float64())), ("m", pa.int64())]))

    data = mapped(rows, vectors, "toxic int, i array<int>, v array<double>, m long").collect()
    data.sort(key=lambda r: (r["toxic"], r["m"], r["i"], r["v"]))
    x = np.zeros((len(data), len(words)))
    for row, r in zip(x, data):
        row[r["i"]] = r["v"]
    graded = np.array([r["m"] for r in data if r["toxic"] == 1])
    cuts = np.unique(np.quantile(graded, [i / (levels - 1) for i in range(1, levels - 1)], method="lower"))
    y = np.array([0 if r["toxic"] == 0 else 1 + int((r["m"] > cuts).sum()) for r in data])
    present, y = np.unique(y, return_inverse=True)  # a grade without rows is left out of the scale
    if len(present) < 2:
        return Ordinal([], [], [])
    w, theta = fit_ordinal(x, y, len(present))
    return Ordinal(words, [float(v) for v in w], [float(t) for t in theta])


COLUMNS = (("severity", "double"), ("grade", "int"), ("p_toxic", "double"))


def grade_texts(docs: DataFrame, model: Ordinal, text_col: str = "text", prefix: str = "tox_") -> DataFrame:
    """`docs` with expected severity, most probable grade and P(grade > 0)."""
    import pyarrow as pa

    weight = dict(zip(model.words, model.weights))
    gate = {w.rstrip("$")[:STARTS[0]] for w in weight}
    theta = np.array(model.thresholds)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part in slices(batch, batch.schema.names[at]):
                z = []
                for text in part.column(at).to_pylist():
                    words = tokens(text or "") if weight else []
                    hits = features(Counter(w for w in words if w[:STARTS[0]] in gate))
                    z.append(damping(len(words)) * sum(weight[w] * c for w, c in sorted(hits.items()) if w in weight))
                above = 1 / (1 + np.exp(np.clip(theta[None, :] - np.array(z)[:, None], -500, 500))) if len(theta) else np.zeros((len(z), 1))
                mass = np.diff(np.concatenate([np.ones((len(z), 1)), above, np.zeros((len(z), 1))], axis=1) * -1, axis=1)
                new = [pa.array(above.sum(axis=1), pa.float64()), pa.array(mass.argmax(axis=1), pa.int32()),
                       pa.array(above[:, 0], pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *(prefix + c for c, _ in COLUMNS)])

    return mapped(docs, run, extended(docs.schema, [(prefix + n, kind) for n, kind in COLUMNS]))


def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return grade_texts(docs, model).select("doc_id", F.col("tox_severity").alias("severity"), F.col("tox_grade").alias("grade"),
                                           F.col("tox_p_toxic").alias("p_toxic"), (F.col("tox_p_toxic") >= 0.5).alias("toxic"))


QUERIES = {"op9_toxicity": (op9_toxicity, None)}
