"""Mixed logit by simulated likelihood: some coefficients are normal over chains, their spreads positive by an exponential.

Each chain's probability is its mean over the draws. The draws are a few hundred rows that go to every task; a chain becomes one row of
arrays, a task takes some thousand of them at a time, and gives one row of sums.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farebox.operators import latent

#: The bounds of the uniform draws before the inverse of the normal distribution.
CLIP = (0.001, 0.999)
PRIMES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29)


def halton(n: int, base: int) -> np.ndarray:
    """The first n numbers of a Halton sequence, from 1 on: their digits mirrored at the point."""
    left, out, scale = np.arange(1, n + 1), np.zeros(n), 1.0
    while left.any():
        scale /= base
        out += scale * (left % base)
        left //= base
    return out


def normal_draws(n: int, dimensions: int) -> np.ndarray:
    """n draws of independent standard normals, each dimension from the sequence of its prime."""
    inverse = np.vectorize(NormalDist().inv_cdf)
    return np.stack([inverse(np.clip(halton(n, p), *CLIP)) for p in PRIMES[:dimensions]], axis=1)


def _sums(x: np.ndarray, first: np.ndarray, params: np.ndarray, fixed: int, draws: np.ndarray) -> np.ndarray:
    """The number of some chains, their log likelihood and its gradient; rows of a chain follow one another, the choice first."""
    k = draws.shape[1]
    spread = np.exp(params[-k:])
    sizes = np.diff(np.append(first, len(x)))
    total, weighted = np.zeros(first.size), np.zeros((first.size, params.size))
    for z in draws:
        v = x[:, :fixed] @ params[:fixed] + x[:, fixed:] @ (params[fixed:-k] + spread * z)
        e = np.exp(v - np.repeat(np.maximum.reduceat(v, first), sizes))
        p = e / np.repeat(np.add.reduceat(e, first), sizes)
        mine = p[first]
        total += mine
        off = x[first] - np.add.reduceat(p[:, None] * x, first, axis=0)
        weighted += mine[:, None] * np.hstack([off, off[:, fixed:] * (spread * z)])
    mean = total / len(draws)
    return np.concatenate([[first.size, np.log(mean + 1e-10).sum()], (weighted / len(draws) / (mean + 1e-10)[:, None]).sum(axis=0)])


def totals(chains: DataFrame, fixed: list[str], random: list[str], params: np.ndarray, draws: np.ndarray) -> tuple[int, float, np.ndarray]:
    """The number of grouped chains, their simulated log likelihood and its gradient (coefficients of fixed, means of random, logarithms of their
    spreads), in one pass."""
    names, params = [*fixed, *random], np.asarray(params, float)

    def run(batches):
        found = np.zeros(2 + params.size)
        for batch in batches:
            if batch.num_rows:
                first = batch.column(0).offsets.to_numpy()[:-1].astype(np.int64)
                x = np.stack([c.flatten().to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
                found += _sums(x, first - first[0], params, len(fixed), draws)
        yield pa.RecordBatch.from_arrays([pa.array([found.tolist()], pa.list_(pa.float64()))], names=["sums"])

    each = chains.select(*names).mapInArrow(run, "sums array<double>")
    row = [x or 0.0 for x in each.agg(*(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(2 + params.size))).first()]
    return int(row[0]), row[1], np.array(row[2:])


def likelihood(chains: DataFrame, fixed: list[str], random: list[str], params: np.ndarray, draws: np.ndarray) -> tuple[float, np.ndarray]:
    """The simulated log likelihood of grouped chains and its gradient."""
    return totals(chains, fixed, random, params, draws)[1:]


def grouped(df: DataFrame, *names: str) -> DataFrame:
    """One row for each chain with exactly one choice: an array for each attribute, the choice first."""
    return latent.packed(df, list(names), [])


def fit(df: DataFrame, fixed: list[str], random: list[str], n_draws: int = 500, rounds: int = 100, tolerance: float = 1e-5) -> dict:
    """Parameters of the largest simulated likelihood, with standard errors (of a spread by the delta method), z values and convergence.

    Quasi-Newton steps on distributed gradients; errors come from central differences of the gradient.
    """
    draws = normal_draws(n_draws, len(random))
    rows = grouped(df, *fixed, *random).persist()
    try:
        chains = max(rows.count(), 1)
        value = lambda x: tuple(-y / chains for y in likelihood(rows, fixed, random, x, draws))
        x = np.concatenate([np.zeros(len(fixed) + len(random)), np.full(len(random), math.log(0.1))])
        (f, g), inverse, converged = value(x), np.eye(x.size), False
        for _ in range(rounds):
            if np.abs(g).max() < tolerance:
                converged = True
                break
            step = -inverse @ g
            if step @ g >= 0:
                inverse, step = np.eye(x.size), -g
            size = min(1.0, 1.0 / np.abs(step).max())
            f2, g2 = value(x + size * step)
            while f2 > f + 1e-4 * size * (g @ step) and size > 1e-8:
                size /= 2
                f2, g2 = value(x + size * step)
            if size <= 1e-8:
                converged = bool(np.abs(g).max() < 1e-3)
                break
            s, d = size * step, g2 - g
            if s @ d > 1e-12:
                r = np.eye(x.size) - np.outer(s, d) / (s @ d)
                inverse = r @ inverse @ r.T + np.outer(s, s) / (s @ d)
            x, f, g = x + s, f2, g2
        e = 1e-4
        hessian = np.stack([(value(x + e * u)[1] - value(x - e * u)[1]) / (2 * e) for u in np.eye(x.size)]) * chains
    finally:
        rows.unpersist()
    k = len(random)
    errors = np.sqrt(np.maximum(np.diag(np.linalg.pinv((hessian + hessian.T) / 2)), 0))
    values, errors = np.concatenate([x[:-k], np.exp(x[-k:])]), np.concatenate([errors[:-k], errors[-k:] * np.exp(x[-k:])])
    names = [*fixed, *(f"mean_{n}" for n in random), *(f"spread_{n}" for n in random)]
    found = {n: {"value": float(v), "se": float(s), "z": float(v / s) if s else float("nan")} for n, v, s in zip(names, values, errors, strict=True)}
    return {"ll": -f * chains, "converged": converged, "parameters": found}


def weight_interval(mean: float, spread: float, per: float, z: float = 1.96) -> tuple[float, float]:
    """Where 95 % of the chains have the weight of an attribute in units of the coefficient `per`."""
    return (abs(mean) - z * spread) / abs(per), (abs(mean) + z * spread) / abs(per)
