"""Independent components per run by symmetric fixed-point iteration (tanh contrast).

The whitening comes from the run's moments. Samples move once, to (run, block), where they are whitened; a step needs only sums
over blocks. Runs of one block have their sums at hand and iterate where they lie, several at once; the whitened blocks of longer runs are stored,
and each step reads them in place, adds up partial sums per task and run, and takes the small matrices along by broadcast
(their size is checked; beyond the bound they are joined by shuffling).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import linalg
from ..schema import KEYS
from ..session import cut_lineage
from .moments import moments, scaled

#: Numbers of unmixing matrices that may be broadcast (32 MB).
BROADCAST_NUMBERS = 1 << 22
#: Samples of one bucket, and runs that iterate together in it.
AT_ONCE, TOGETHER = 1 << 15, 64


def decorrelate(w: np.ndarray) -> np.ndarray:
    """(W W')^-1/2 W, which makes the rows orthonormal."""
    lam, vec = np.linalg.eigh(w @ w.T)
    lam = np.clip(lam, np.finfo(float).tiny, None)
    return vec @ np.diag(lam ** -0.5) @ vec.T @ w


def start(n: int, seed: int) -> np.ndarray:
    return decorrelate(np.random.RandomState(seed).normal(size=(n, n)))


def step_sums(w: np.ndarray, white: np.ndarray):
    """Sums over samples needed for one step: g(Wx) x' and g'(Wx)."""
    g = np.tanh(white @ w.T)
    return g.T @ white, (1.0 - g * g).sum(axis=0)


def step(w: np.ndarray, gx: np.ndarray, gp: np.ndarray, n: int):
    """New matrix and its distance from the old one."""
    new = decorrelate(gx / n - (gp / n)[:, None] * w)
    return new, float(np.max(np.abs(np.abs((new * w).sum(axis=1)) - 1.0)))


def whitening(mean, cov, n, k):
    """Unit-variance whitening to k components (k x d)."""
    lam, vec = linalg.sorted_eigh(cov)
    if not lam[min(k, len(lam)) - 1] > 0 or n <= k:
        raise ValueError("rank below the number of components")
    return (vec[:, :k] / np.sqrt(lam[:k])).T


def kurtosis(s: np.ndarray) -> np.ndarray:
    c = s - s.mean(axis=0)
    return (c ** 4).mean(axis=0) / (c ** 2).mean(axis=0) ** 2 - 3.0


def _key_types(rows) -> str:
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return ", ".join(f"{c} {types[c]}" for c in KEYS)


def result(w: np.ndarray, kurt: np.ndarray, base: np.ndarray):
    """Kurtosis values and rows of the matrix on raw samples, largest kurtosis first."""
    order = np.argsort(-np.abs(kurt), kind="stable")
    return kurt[order].tolist(), (w @ base)[order].tolist()


def solve_together(whites: list, k: int, max_iter: int, tol: float, seed: int) -> list:
    """(matrix, last distance) of several runs from their whitened samples: the steps of ``step``, taken by all runs at once.

    Shorter runs are filled up with zeros, which add nothing to g(Wx) x' and to the squares of g."""
    n = np.array([len(x) for x in whites], dtype=float)
    x = np.zeros((len(whites), max(len(x) for x in whites), k))
    for i, one in enumerate(whites):
        x[i, :len(one)] = one
    w, lim = np.repeat(start(k, seed)[None], len(whites), axis=0), np.full(len(whites), np.inf)
    at, held, size, going = np.arange(len(whites)), x, n, w
    for _ in range(max_iter):
        g = np.tanh(held @ going.transpose(0, 2, 1))
        gp = size[:, None] - (g * g).sum(axis=1)
        lam, vec = np.linalg.eigh((m := g.transpose(0, 2, 1) @ held / size[:, None, None] - (gp / size[:, None])[:, :, None] * going)
                                  @ m.transpose(0, 2, 1))
        lam = np.clip(lam, np.finfo(float).tiny, None)
        new = (vec * lam[:, None, :] ** -0.5) @ vec.transpose(0, 2, 1) @ m
        far = np.max(np.abs(np.abs((new * going).sum(axis=2)) - 1.0), axis=1)
        w[at], lim[at] = new, far
        open_ = ~(far < tol)
        if not open_.any():
            break
        at, held, size, going = (at, held, size, new) if open_.all() else (at[open_], held[open_], size[open_], new[open_])
    return list(zip(w, lim))


def whitened(rows: DataFrame, table: DataFrame, k: int, max_iter: int, tol: float, seed: int, block: int) -> DataFrame:
    """One row per (run, block): the solution where that is the whole run, else the whitened samples (``white``).

    Blocks meet their matrices in buckets of about AT_ONCE samples: a bucket is one call, and its runs of one block iterate together."""
    table = table.select(*KEYS, "n", "last_t", "kmat", "kcen").dropna(subset=KEYS)
    total = table.agg(F.sum("n")).first()[0] or 0
    buckets, blk = -(-total // AT_ONCE) or 1, F.expr(f"t div {block}")
    place = F.pmod(F.xxhash64(*KEYS, "blk"), F.lit(buckets))
    left = rows.dropna(subset=KEYS).select(*KEYS, "t", "x", blk.alias("blk")).withColumn("bucket", place)
    right = table.withColumn("blk", F.explode_outer(F.expr(f"sequence(0L, cast(last_t as bigint) div {block})"))).withColumn(
        "bucket", place).select(*KEYS, "blk", "last_t", "kmat", "kcen", "bucket").toDF(
        *[f"_{c}" for c in (*KEYS, "blk", "last_t", "kmat", "kcen", "bucket")])
    columns = [*KEYS, "values", "w", "converged", "white"]

    def run(samples: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        names = [*KEYS, "blk"]
        matrices = {key: (last, np.stack(base), np.asarray(centre)) for *key, last, base, centre in side[
            [f"_{c}" for c in (*names, "last_t", "kmat", "kcen")]].itertuples(index=False, name=None) for key in [tuple(key)]}
        out, ready = [], []
        for key, part in samples.sort_values([*names, "t"]).groupby(names, sort=False):
            if key not in matrices:
                continue
            last, base, centre = matrices[key]
            white = (np.stack(part["x"].to_numpy()) - centre) @ base.T
            if last >= block:
                out.append([*key[:-1], None, None, None, white.tobytes()])
            else:
                ready.append((key[:-1], white, base))
        ready.sort(key=lambda r: len(r[1]))
        for lo in range(0, len(ready), TOGETHER):
            some = ready[lo:lo + TOGETHER]
            for (key, white, base), (w, lim) in zip(some, solve_together([r[1] for r in some], k, max_iter, tol, seed)):
                values, matrix = result(w, kurtosis(white @ w.T), base)
                out.append([*key, values, matrix, int(lim < tol), None])
        return pd.DataFrame(out, columns=columns)

    return left.groupBy("bucket").cogroup(right.groupBy("_bucket")).applyInPandas(
        run, f"{_key_types(rows)}, values array<double>, w array<array<double>>, converged int, white binary")


def by_steps(blocks: DataFrame, table: DataFrame, k: int, max_iter: int, tol: float, seed: int) -> DataFrame:
    """Runs of several blocks, from their stored whitened blocks (keys, white): one pass of sums per step."""
    key_types, cells = _key_types(blocks), k * k + k
    state = cut_lineage(table.select(*KEYS, "n", "kmat").withColumn("w", F.lit(start(k, seed).tolist())).withColumn(
        "lim", F.lit(float("inf"))))
    small = state.count() * k * k <= BROADCAST_NUMBERS

    def pieces(frames):
        """One partial sum per run and task."""
        held: dict = {}
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                white, w = np.frombuffer(row.white).reshape(-1, k), np.stack(row.w)
                gx, gp = step_sums(w, white)
                s = white @ w.T
                v = np.concatenate([gx.ravel(), gp, *[(s ** p).sum(axis=0) for p in (1, 2, 3, 4)]])
                key = tuple(getattr(row, c) for c in KEYS)
                held[key] = held[key] + v if key in held else v
        if held:
            yield pd.DataFrame([[*key, v.tolist()] for key, v in held.items()], columns=[*KEYS, "v"])

    def sums(current):
        """The partial vectors of every run added up position by position, as one array."""
        matrices = current.select(*KEYS, "w")
        joined = blocks.join(F.broadcast(matrices) if small else matrices, KEYS)
        parts = joined.mapInPandas(pieces, f"{key_types}, v array<double>")
        total = parts.select(*KEYS, F.posexplode_outer("v").alias("pos", "v")).groupBy(*KEYS, "pos").agg(F.sum("v").alias("v"))
        return total.groupBy(*KEYS).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))),
                                                    lambda e: e["v"]).alias("v"))

    def advance(frames):
        for pdf in frames:
            new, lims = [], []
            for r in pdf.itertuples(index=False):
                if r.lim < tol:  # done; it keeps its matrix
                    new.append([list(row) for row in r.w])
                    lims.append(r.lim)
                    continue
                v = np.asarray(r.v)
                w, lim = step(np.stack(r.w), v[:k * k].reshape(k, k), v[k * k:cells], r.n)
                new.append(w.tolist())
                lims.append(lim)
            yield pdf.drop(columns=["v"]).assign(w=new, lim=lims)

    schema = f"{key_types}, n bigint, kmat array<array<double>>, w array<array<double>>, lim double"
    columns = [*KEYS, "n", "kmat", "w", "lim"]
    for _ in range(max_iter):
        going = state.where(F.col("lim") >= tol)
        state = cut_lineage(state.join(sums(going), KEYS, "left").select(*columns, "v").mapInPandas(advance, schema))
        if state.where(F.col("lim") >= tol).isEmpty():
            break

    def finish(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                s1, s2, s3, s4 = np.asarray(r.v)[cells:].reshape(4, k) / r.n
                var = s2 - s1 ** 2
                kurt = (s4 - 4 * s1 * s3 + 6 * s1 ** 2 * s2 - 3 * s1 ** 4) / var ** 2 - 3.0
                out.append([*(getattr(r, c) for c in KEYS), *result(np.stack(r.w), kurt, np.stack(r.kmat)), int(r.lim < tol)])
            yield pd.DataFrame(out, columns=[*KEYS, "values", "w", "converged"])

    return state.join(sums(state), KEYS).select(*columns, "v").mapInPandas(
        finish, f"{key_types}, values array<double>, w array<array<double>>, converged int")


def unmix(rows: DataFrame, width: int, k: int, mode: str, scaler, max_iter: int = 1000, tol: float = 1e-3,
          seed: int = 42, block: int = 4096) -> DataFrame:
    """Per run: kurtosis values, unmixing matrix on raw samples (k x d), centre, status.

    Scaling is folded into the matrices, so the samples stay raw.
    """
    table = moments(rows.withColumn("z", F.col("x")), width)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{c} {types[c]}" for c in KEYS) + \
        ", n bigint, last_t bigint, kmat array<array<double>>, kcen array<double>, status string, error string"

    def whiten(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                raw = np.asarray(r.mean)
                try:
                    _, cov = scaled(raw, linalg.unpack(r.cov, width), width, mode, scaler, 1)
                    base = whitening(raw, cov, r.n, k)
                    if mode == "scaler":
                        base = base / np.asarray(scaler.std)
                    out.append([*(getattr(r, c) for c in KEYS), r.n, r.last_t, base.tolist(), raw.tolist(), "ok", None])
                except Exception as exc:
                    out.append([*(getattr(r, c) for c in KEYS), r.n, r.last_t, None, None, "failed", str(exc)])
            yield pd.DataFrame(out, columns=[*KEYS, "n", "last_t", "kmat", "kcen", "status", "error"])

    white = cut_lineage(table.mapInPandas(whiten, schema))  # one row per run, read by all that follows
    good = white.where("status = 'ok'")
    parts = cut_lineage(whitened(rows, good, k, max_iter, tol, seed, block))  # no reader iterates again
    longer = good.where(F.col("last_t") >= block)
    solved = parts.drop("white")
    if not longer.isEmpty():
        far = by_steps(parts.where("white is not null").select(*KEYS, "white"), longer, k, max_iter, tol, seed)
        solved = parts.where("white is null").drop("white").unionByName(far)
    return white.drop("kmat").join(solved, KEYS, "left")


def ica_spectrum(rows: DataFrame, cfg, width: int, mode: str, scaler) -> DataFrame:
    out = unmix(rows, width, min(cfg.numerics.components, width), mode, scaler, cfg.numerics.steps, cfg.numerics.tolerance,
                cfg.numerics.seed, cfg.block)
    return out.select(*KEYS, "n", "values", "converged", "status", "error")
