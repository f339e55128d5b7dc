"""Latent classes of travellers: a logit of membership over covariates of the chain, times a logit of choice in each class.

Rows are alternatives (chain_id, choice, attributes and covariates). Scores are windows over the chain, then one row a chain. To fit, a chain
becomes one row of arrays, kept in memory or on disk of the executors; a pass over these rows gives the likelihoods and gradients of many sets of
parameters at once, those of all starts and of several steps of each, as one row of sums for each set and task. The driver sees as many
numbers as there are sets and parameters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from farebox.operators.choice import of_chain

#: Bounds of the coefficients of choice and of membership.
CHOICE_BOUND, MEMBER_BOUND = 5.0, 10.0
#: Decimals to which probabilities of classes are compared.
DIGITS = 9


def _linear(names: list[str], values: list[float]) -> Column:
    return sum((F.col(n) * float(v) for n, v in zip(names, values, strict=True)), F.lit(0.0))


def _softmax(v: list[Column]) -> list[Column]:
    top = F.greatest(*v) if len(v) > 1 else v[0]
    e = [F.exp(x - top) for x in v]
    total = sum(e[1:], e[0])
    return [x / total for x in e]


def members(covariates: list[str], classes: list[list[float]]) -> list[Column]:
    """The probability of each class; classes: intercept and coefficients of all classes but the last, which has none."""
    return _softmax([*(_linear(covariates, c[1:]) + float(c[0]) for c in classes), F.lit(0.0)])


def with_mixture(df: DataFrame, names: list[str], betas: list[list[float]], covariates: list[str], classes: list[list[float]]) -> DataFrame:
    """df with p_k, the choice probability in each class, pi_k, the probability of the class, and p, their mixture."""
    df = df.withColumns({f"_v{k}": _linear(names, b) for k, b in enumerate(betas)} | {f"pi_{k}": p for k, p in enumerate(members(covariates, classes))})
    df = df.withColumns({f"_e{k}": F.exp(F.col(f"_v{k}") - F.max(f"_v{k}").over(of_chain())) for k in range(len(betas))})
    df = df.withColumns({f"p_{k}": F.col(f"_e{k}") / F.sum(f"_e{k}").over(of_chain()) for k in range(len(betas))})
    mixture = sum((F.col(f"pi_{k}") * F.col(f"p_{k}") for k in range(len(betas))), F.lit(0.0))
    return df.withColumn("p", mixture).drop(*(f"_{x}{k}" for x in "ve" for k in range(len(betas))))


def posteriors(mixed: DataFrame, k: int) -> DataFrame:
    """(chain_id, post_0.., class): the probability of each class given the choice, and the likeliest class, the first on ties. Probabilities that are
    equal to DIGITS decimals tie: the last bits depend on the order of sums, and many chains are as likely in both classes."""
    chosen = mixed.where("choice = 1")
    post = [F.col(f"pi_{i}") * F.col(f"p_{i}") / F.col("p") for i in range(k)]
    rows = chosen.select("chain_id", *(x.alias(f"post_{i}") for i, x in enumerate(post)))
    rounded = [F.round(f"post_{i}", DIGITS) for i in range(k)]
    best = F.greatest(*rounded)
    out = F.lit(k - 1)
    for i in range(k - 2, -1, -1):
        out = F.when(rounded[i] == best, i).otherwise(out)
    return rows.withColumn("class", out)


def profiles(assigned: DataFrame, chains: DataFrame, *traits: str) -> DataFrame:
    """For each class its chains, share and the mean of some traits of chains (chain_id and traits)."""
    rows = assigned.join(chains.select("chain_id", *traits), "chain_id")
    found = rows.groupBy("class").agg(F.count("*").alias("chains"), *(F.avg(t).alias(f"mean_{t}") for t in traits))
    return found.withColumn("share", F.col("chains") / F.sum("chains").over(Window.partitionBy()))  # one row a class


def packed(df: DataFrame, names: list[str], covariates: list[str]) -> DataFrame:
    """One row for each chain with exactly one choice: an array for each attribute, the place of the choice, the covariates."""
    order = F.struct(F.col("choice"), *(F.col(n).cast("double").alias(n) for n in names))
    rows = df.groupBy("chain_id").agg(F.sum("choice").alias("_c"), F.sort_array(F.collect_list(order), asc=False).alias("_a"), *(F.first(c).cast("double").alias(c) for c in covariates))
    return rows.where("_c = 1").select(*(F.col(f"_a.{n}").alias(n) for n in names), *covariates)  # the choice comes first


def _sums(x: np.ndarray, first: np.ndarray, z: np.ndarray, betas: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The log likelihood of chains and its gradient in the order of betas, then classes. Rows of a chain follow one another, the choice first;
    z: the covariates with a leading 1."""
    sizes = np.diff(np.append(first, len(x)))
    v = np.hstack([z @ classes.T, np.zeros((len(z), 1))])
    pi = np.exp(v - v.max(axis=1, keepdims=True))
    pi /= pi.sum(axis=1, keepdims=True)
    mine, off = np.empty_like(pi), []
    for k, b in enumerate(betas):
        u = x @ b
        e = np.exp(u - np.repeat(np.maximum.reduceat(u, first), sizes))
        p = e / np.repeat(np.add.reduceat(e, first), sizes)
        mine[:, k] = p[first]
        off.append(x[first] - np.add.reduceat(p[:, None] * x, first, axis=0))
    both = pi * mine
    total = both.sum(axis=1)
    post = both / np.maximum(total, 1e-300)[:, None]
    out = [np.log(np.maximum(total, 1e-300)).sum()]
    for k in range(len(betas)):
        out += (post[:, k] @ off[k]).tolist()
    for k in range(len(classes)):
        out += ((post[:, k] - pi[:, k]) @ z).tolist()
    return np.array(out)


def evaluate(chains: DataFrame, names: list[str], covariates: list[str], k: int, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The log likelihoods and gradients of sets of parameters (a row each: coefficients of all classes, then of membership), in one pass over
    packed chains."""
    sets, nb = np.asarray(sets, float), k * len(names)

    def run(batches):
        found = np.zeros((len(sets), 1 + sets.shape[1]))
        for batch in batches:
            if batch.num_rows:
                first = np.frombuffer(batch.column(0).buffers()[1], np.int32)[batch.column(0).offset :][: batch.num_rows].astype(np.int64)
                x = np.stack([batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in range(len(names))], axis=1)
                z = np.stack([np.ones(batch.num_rows), *(batch.column(len(names) + i).to_numpy(zero_copy_only=False) for i in range(len(covariates)))], axis=1)
                for i, s in enumerate(sets):
                    found[i] += _sums(x, first - first[0], z, s[:nb].reshape(k, len(names)), s[nb:].reshape(k - 1, 1 + len(covariates)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sets))), pa.array(found.tolist(), pa.list_(pa.float64()))], names=["set", "sums"])

    each = chains.select(*names, *covariates).mapInArrow(run, "set long, sums array<double>")
    rows = each.groupBy("set").agg(*(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(1 + sets.shape[1]))).collect()
    out = np.zeros((len(sets), 1 + sets.shape[1]))
    for r in rows:
        out[r["set"]] = list(r)[1:]
    return out[:, 0], out[:, 1:]


class _Start:
    """A quasi-Newton search within bounds: it proposes points and takes the first that is good enough."""

    def __init__(self, x: np.ndarray, bound: np.ndarray, tolerance: float) -> None:
        self.x, self.bound, self.tolerance, self.inverse = x, bound, tolerance, np.eye(x.size)
        self.f, self.g, self.size, self.step = np.inf, np.zeros(x.size), 0.0, np.zeros(x.size)
        self.ended = self.converged = False

    def begin(self, f: float, g: np.ndarray) -> None:
        self.f, self.g = f, g
        free = ~((self.x >= self.bound) & (g < 0) | (self.x <= -self.bound) & (g > 0))
        if np.abs(g * free).max() < self.tolerance:
            self.ended = self.converged = True
            return
        self.step = -(self.inverse @ (g * free)) * free
        if self.step @ g >= 0:
            self.inverse, self.step = np.eye(self.x.size), -g * free
        self.size = min(1.0, 2.0 / np.abs(self.step).max())

    def proposed(self, n: int) -> np.ndarray:
        return np.stack([np.clip(self.x + self.size * 0.5**i * self.step, -self.bound, self.bound) for i in range(n)])

    def told(self, points: np.ndarray, f: np.ndarray, g: np.ndarray) -> None:
        for x, f2, g2 in zip(points, f, g, strict=True):
            if f2 <= self.f + 1e-4 * (self.g @ (x - self.x)):
                s, d = x - self.x, g2 - self.g
                if s @ d > 1e-12:
                    r = np.eye(s.size) - np.outer(s, d) / (s @ d)
                    self.inverse = r @ self.inverse @ r.T + np.outer(s, s) / (s @ d)
                self.x = x
                self.begin(f2, g2)
                return
        self.size *= 0.5 ** len(points)
        if self.size < 1e-8:
            free = ~((self.x >= self.bound) & (self.g < 0) | (self.x <= -self.bound) & (self.g > 0))
            self.ended, self.converged = True, bool(np.abs(self.g * free).max() < 1e-3)


def fit(df: DataFrame, names: list[str], covariates: list[str], k: int, starts: int = 3, rounds: int = 200, tolerance: float = 1e-5, steps: int = 4) -> dict:
    """Parameters of k classes with the largest likelihood of some starts: log likelihood, parameters, BIC, whether the best start converged, and
    the log likelihood and convergence of each start (starts).

    Quasi-Newton searches within bounds, all starts together: a round is one pass over the chains, for `steps` points of each start that hasn't ended.
    """
    nb, nc = k * len(names), (k - 1) * (1 + len(covariates))
    bound = np.array([CHOICE_BOUND] * nb + [MEMBER_BOUND] * nc)
    rows = packed(df, names, covariates).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        chains = max(rows.count(), 1)

        def value(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            ll, g = evaluate(rows, names, covariates, k, points)
            return -ll / chains, -g / chains

        searches = [_Start(np.random.default_rng(s).normal(0, 0.3, nb + nc), bound, tolerance) for s in range(starts)]
        for search, f, g in zip(searches, *value(np.stack([s.x for s in searches])), strict=True):
            search.begin(f, g)
        for _ in range(rounds):
            active = [s for s in searches if not s.ended]
            if not active:
                break
            points = [s.proposed(steps) for s in active]
            f, g = value(np.concatenate(points))
            for i, (search, own) in enumerate(zip(active, points, strict=True)):
                search.told(own, f[i * steps : (i + 1) * steps], g[i * steps : (i + 1) * steps])
    finally:
        rows.unpersist()
    best = min(searches, key=lambda s: s.f)
    ll = -best.f * chains
    betas, classes = best.x[:nb].reshape(k, -1).tolist(), best.x[nb:].reshape(k - 1, -1).tolist() if nc else []
    told = [{"ll": -s.f * chains, "converged": bool(s.converged)} for s in searches]
    return {"ll": ll, "betas": betas, "classes": classes, "bic": (nb + nc) * float(np.log(chains)) - 2 * ll, "converged": bool(best.converged), "starts": told}


def choose(df: DataFrame, names: list[str], covariates: list[str], ks: tuple[int, ...] = (2, 3, 4, 5), **more) -> dict:
    """The fit with the least BIC."""
    found = [fit(df, names, covariates, k, **more) | {"k": k} for k in ks]
    return min(found, key=lambda x: x["bic"])
