"""Tests of models: likelihood ratio, Wald, Hausman, association of classes, and how often the choice is among the likeliest.

Likelihoods, gradients and cell counts are distributed sums; what the driver sees is as large as a model has parameters.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from farebox.functions.special import chi2_tail
from farebox.operators.choice import fitted, of_chain


def likelihood_ratio(ll: Column, ll_restricted: Column, restrictions: Column) -> Column:
    """(statistic, dof, p) of a model against one nested in it."""
    statistic = 2.0 * (ll - ll_restricted)
    return F.struct(statistic.alias("statistic"), restrictions.cast("int").alias("dof"), chi2_tail(statistic, restrictions).alias("p"))


def quadratic(x: np.ndarray, covariance: np.ndarray) -> float:
    return float(x @ np.linalg.pinv(covariance) @ x)


def wald(beta: np.ndarray, covariance: np.ndarray, restriction: np.ndarray, value: np.ndarray) -> tuple[float, int]:
    """Statistic and degrees of freedom of the hypothesis restriction @ beta = value."""
    return quadratic(restriction @ beta - value, restriction @ covariance @ restriction.T), restriction.shape[0]


def hausman(efficient: tuple[np.ndarray, np.ndarray], consistent: tuple[np.ndarray, np.ndarray]) -> tuple[float, int]:
    """Statistic and degrees of freedom of two fits (coefficients, covariance) of one model, the second on fewer alternatives.

    The difference of the covariances need not be positive; its pseudoinverse and rank count, and a negative statistic speaks for equality.
    """
    difference = consistent[1] - efficient[1]
    return quadratic(consistent[0] - efficient[0], difference), int(np.linalg.matrix_rank(difference))


def without_alternatives(df: DataFrame, dropped: Column) -> DataFrame:
    """Choice sets without some alternatives: chains that chose one of them, or have one alternative left, go."""
    kept = df.where(~F.coalesce(dropped, F.lit(False)))
    rows = kept.withColumns({"_c": F.sum("choice").over(of_chain()), "_n": F.count("*").over(of_chain())})
    return rows.where("_c = 1 and _n > 1").drop("_c", "_n")


def nested_tests(spark: SparkSession, df: DataFrame, names: list[str], restricted: list[str], dropped: Column) -> DataFrame:
    """(test, statistic, dof, p): of the logit with names, whether the restricted ones are 0 (likelihood ratio, Wald), and whether the coefficients
    are those of the choice sets without some alternatives (Hausman). Three fits, each a series of distributed aggregations."""
    full, short = fitted(df, names), fitted(df, [n for n in names if n not in restricted])
    fewer = fitted(without_alternatives(df, dropped), names)
    rows = np.array([[float(n == r) for n in names] for r in restricted])
    w, w_dof = wald(full["beta"], full["covariance"], rows, np.zeros(len(restricted)))
    h, h_dof = hausman((full["beta"], full["covariance"]), (fewer["beta"], fewer["covariance"]))
    found = [("likelihood_ratio", 2 * (full["ll"] - short["ll"]), len(restricted)), ("wald", w, w_dof), ("hausman", h, h_dof)]
    told = spark.createDataFrame([(t, float(s), int(k)) for t, s, k in found], "test string, statistic double, dof int")
    return told.withColumn("p", chi2_tail(F.col("statistic"), F.col("dof")))


def association(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: chi2, dof, p and cramers_v of two categories. Rows are counted by both first; one row a cell is left then. A single category
    gives no degree of freedom, p 1 and no association."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    over = lambda *by: F.sum("n").over(Window.partitionBy(*by))
    rows = cells.withColumns({"na": over("a"), "nb": over("b"), "t": over()})
    n = lambda c: F.size(F.collect_set(F.struct(c)))
    s = rows.agg((F.sum(F.col("n") * F.col("n") / (F.col("na") * F.col("nb") / F.col("t"))) - F.max("t")).alias("x"), n("a").alias("ra"), n("b").alias("rb"), F.max("t").alias("t"))
    least, dof = F.least("ra", "rb") - 1, (F.col("ra") - 1) * (F.col("rb") - 1)
    chi2 = F.when(dof > 0, F.greatest("x", F.lit(0.0))).otherwise(0.0)
    v = F.when(least > 0, F.sqrt(chi2 / (F.col("t") * least))).otherwise(0.0)
    return s.select(chi2.alias("chi2"), dof.alias("dof"), F.when(dof > 0, chi2_tail(chi2, dof)).otherwise(1.0).alias("p"), v.alias("cramers_v"))


def top_k_accuracy(df: DataFrame, score: str, ks: tuple[int, ...], *by: str) -> DataFrame:
    """The share of chains whose choice is among the k alternatives with the largest scores (ties: the smaller alt_id), as top_k for each k."""
    place = F.row_number().over(of_chain().orderBy(F.desc(score), "alt_id"))
    chosen = df.withColumn("_place", place).where("choice = 1")
    return chosen.groupBy(*by).agg(F.count("*").alias("chains"), *(F.avg((F.col("_place") <= k).cast("int")).alias(f"top_{k}") for k in ks))
