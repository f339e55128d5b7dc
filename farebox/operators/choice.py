"""Choice sets: utilities, logit probabilities, picks, fit statistics. Rows are alternatives; a chain's rows form one choice set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def of_chain() -> WindowSpec:
    return Window.partitionBy("chain_id")



def utility(betas: dict[str, float]) -> Column:
    """The linear utility of an alternative."""
    return reduce(lambda a, b: a + b, (F.col(name) * value for name, value in betas.items()))


def utility_by_type(betas: dict[str | None, dict[str, float]], kind: str = "user_type") -> Column:
    """Each type's own coefficients; those of None for any other type."""
    out = utility(betas[None])
    for name, own in betas.items():
        if name is not None:
            out = F.when(F.col(kind) == name, utility(own)).otherwise(out)
    return out


def with_probability(df: DataFrame, v: str = "v", out: str = "p") -> DataFrame:
    """Softmax within the chain; the largest utility is taken off first."""
    e = F.exp(F.col(v) - F.max(v).over(of_chain()))
    return df.withColumn("_e", e).withColumn(out, F.col("_e") / F.sum("_e").over(of_chain())).drop("_e")


def best(what: str, value: Column, alt: str = "alt_id") -> Column:
    """Aggregate: ``what`` of the alternative with the largest value, the first one on ties."""
    return F.max_by(F.col(what), F.struct(value, -F.col(alt)))


def with_choice(df: DataFrame, by: str = "sim") -> DataFrame:
    """Marks the first alternative with the largest similarity as chosen."""
    first = F.row_number().over(of_chain().orderBy(F.desc(by), "alt_id"))
    return df.withColumn("choice", (first == 1).cast("int"))


def fit_statistics(df: DataFrame, parameters: int) -> DataFrame:
    """One row: chains, log likelihoods with and without a model, McFadden's measures, information criteria. df has p and choice."""
    ll = F.sum(F.when(F.col("choice") == 1, F.log("p")))
    per = df.withColumn("n", F.count("*").over(of_chain())).agg(
        F.sum("choice").cast("long").alias("chains"), ll.alias("ll"), F.sum(F.when(F.col("choice") == 1, -F.log("n"))).alias("ll0")
    )
    k = F.lit(float(parameters))
    return per.select(
        "chains", "ll", "ll0",
        (1 - F.col("ll") / F.col("ll0")).alias("rho2"), (1 - (F.col("ll") - k) / F.col("ll0")).alias("rho2_adj"),
        (2 * k - 2 * F.col("ll")).alias("aic"), (k * F.log("chains") - 2 * F.col("ll")).alias("bic"), (k * (F.log("chains") + 1) - 2 * F.col("ll")).alias("caic"),
    )


def clean_chains(df: DataFrame, outlier: Column) -> DataFrame:
    """Drops whole chains that have an outlier (an unknown predicate counts as none), not exactly one choice, or a single alternative."""
    bad = df.where(F.coalesce(outlier, F.lit(False))).select("chain_id").distinct()
    left = df.join(bad, "chain_id", "left_anti")
    left = left.withColumn("_c", F.sum("choice").over(of_chain())).withColumn("_n", F.count("*").over(of_chain()))
    return left.where("_c = 1 and _n > 1").drop("_c", "_n")


def gradient(df: DataFrame, betas: dict[str, float]) -> DataFrame:
    """One row: the log likelihood, its gradient and the lower half of its Hessian at betas. Sums combine before the shuffle."""
    names = list(betas)
    rows = with_probability(df.withColumn("v", utility(betas)))
    rows = rows.withColumns({f"_m_{n}": F.sum(F.col("p") * F.col(n)).over(of_chain()) for n in names})
    outs = [F.sum(F.when(F.col("choice") == 1, F.log("p"))).alias("ll")]
    outs += [F.sum((F.col("choice") - F.col("p")) * F.col(n)).alias(f"g_{n}") for n in names]
    for i, a in enumerate(names):
        outs += [F.sum(-F.col("p") * (F.col(a) - F.col(f"_m_{a}")) * (F.col(b) - F.col(f"_m_{b}"))).alias(f"h_{a}_{b}") for b in names[: i + 1]]
    return rows.agg(*outs)


def fitted(df: DataFrame, names: list[str], rounds: int = 100, tolerance: float = 1e-8) -> dict:
    """Newton's method for a multinomial logit: beta, covariance and log likelihood (ll) at the largest likelihood.

    Each round is one distributed aggregation, the driver solves a system of len(names) unknowns. Only the columns needed are kept for the rounds, in
    memory or on disk of the executors; steps are halved while the likelihood falls. Raises if it hasn't converged after `rounds`.
    """
    import numpy as np
    from pyspark import StorageLevel

    rows = df.select("chain_id", "choice", *names).repartition("chain_id").persist(StorageLevel.MEMORY_AND_DISK)
    try:

        def at(beta):
            r = gradient(rows, dict(zip(names, beta.tolist(), strict=True))).first()
            g = np.array([r[f"g_{n}"] or 0.0 for n in names])
            h = np.array([[r[f"h_{names[max(i, j)]}_{names[min(i, j)]}"] or 0.0 for j in range(len(names))] for i in range(len(names))])
            return r["ll"] or 0.0, g, h

        beta = np.zeros(len(names))
        ll, g, h = at(beta)
        for _ in range(rounds):
            step = np.linalg.lstsq(h, g, rcond=None)[0]
            if np.abs(step).max() < tolerance:
                break
            new = at(beta - step)
            while new[0] < ll - 1e-9 * abs(ll) and np.abs(step).max() > tolerance:
                step = step / 2
                new = at(beta - step)
            beta, (ll, g, h) = beta - step, new
        else:
            raise RuntimeError(f"no convergence after {rounds} rounds; the largest step was {np.abs(step).max():g}")
    finally:
        rows.unpersist()
    return {"beta": beta, "covariance": np.linalg.pinv(-h), "ll": float(ll)}


def fit_logit(df: DataFrame, names: list[str], rounds: int = 100, tolerance: float = 1e-8) -> dict[str, dict[str, float]]:
    """For each name its coefficient in the logit of the largest likelihood, with standard error, t and two-sided p value."""
    import math

    import numpy as np

    found = fitted(df, names, rounds, tolerance)
    errors = np.sqrt(np.maximum(np.diag(found["covariance"]), 0))
    t = [float(b / s) if s else float("nan") for b, s in zip(found["beta"], errors, strict=True)]
    return {n: {"beta": float(b), "se": float(s), "t": x, "p": math.erfc(abs(x) / math.sqrt(2))} for n, b, s, x in zip(names, found["beta"], errors, t, strict=True)}


def fit_by_segment(df: DataFrame, names: list[str], segment: str, least: int = 500) -> dict[object, dict]:
    """A fit for each segment of at least `least` chains; the number of segments is small, and each fit is distributed."""
    sizes = df.where("choice = 1").groupBy(segment).agg(F.count("*").alias("n")).where(F.col("n") >= least).collect()
    return {r[segment]: fit_logit(df.where(F.col(segment).eqNullSafe(F.lit(r[segment]))), names) for r in sorted(sizes, key=lambda r: str(r[segment]))}


def choice_metrics(df: DataFrame, score: str, *by: str) -> DataFrame:
    """Chains, hit rate, mean probability of the choice and log likelihood of any model's positive scores, normalised within the chain."""
    share = F.col(score) / F.sum(score).over(of_chain())
    rows = df.withColumn("_p", share).withColumn("_top", F.row_number().over(of_chain().orderBy(F.desc(score), "alt_id")))
    chosen = rows.where("choice = 1")
    return chosen.groupBy(*by).agg(F.count("*").alias("chains"), F.avg((F.col("_top") == 1).cast("int")).alias("hit_rate"), F.avg("_p").alias("mean_p"), F.sum(F.log(F.greatest("_p", F.lit(1e-300)))).alias("ll"))
