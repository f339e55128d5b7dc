"""Queries on samples, parameter settings, model tests and latent classes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.operators import latent, mixed, modeltests, sampling, settings
from farebox.operators.choice import utility, with_probability
from farebox.plans import derive as d
from farebox.plans.registry import Registry, r6

_registry = Registry()
query, QUERIES, ORACLES = _registry.query, _registry.queries, _registry.oracles

SHARES = {"F": 0.2, "O": 0.3, "P": 0.5}
_TOTAL = 1200


@query(f"""WITH o AS (SELECT o_orderkey, o_orderstatus AS kind, md5(CAST(o_orderkey AS VARCHAR)) AS h FROM orders),
n AS (SELECT count(*) FILTER (kind = 'F') AS f, count(*) FILTER (kind = 'O') AS o, count(*) FILTER (kind = 'P') AS p FROM o),
q AS (SELECT *, least(f, {int(_TOTAL * 0.2)}) AS f1, least(o, {int(_TOTAL * 0.3)}) AS o1,
  least(p, {_TOTAL - int(_TOTAL * 0.2) - int(_TOTAL * 0.3)}) AS p1 FROM n),
r AS (SELECT *, f1 + least({_TOTAL} - f1 - o1 - p1, f - f1) AS f2 FROM q),
s AS (SELECT *, o1 + least({_TOTAL} - f2 - o1 - p1, o - o1) AS o2 FROM r),
t AS (SELECT *, p1 + least({_TOTAL} - f2 - o2 - p1, p - p1) AS p2 FROM s),
k AS (SELECT 'F' AS kind, f AS n, f2 AS quota, f + o + p AS everyone, f2 + o2 + p2 AS sampled FROM t UNION ALL
  SELECT 'O', o, o2, f + o + p, f2 + o2 + p2 FROM t UNION ALL SELECT 'P', p, p2, f + o + p, f2 + o2 + p2 FROM t),
turn AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY h, o_orderkey) AS turn FROM o)
SELECT o_orderkey, kind, round((n / everyone) / (quota / sampled), 6) AS weight FROM turn JOIN k USING (kind) WHERE turn <= quota""")
def filled_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1,200 chains by shares of their kind; what a short kind lacks comes from the others, and weights undo both."""
    rows = d.read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("kind"))
    got = sampling.filled_sample(rows, F.col("kind"), "o_orderkey", SHARES, _TOTAL)
    return got.withColumn("weight", F.round("weight", 6))


_OWN = {k: b for k, b in d.BETAS.items() if k}


@query(f"""WITH {d.SCORED_SQL},
pool AS (SELECT *, {d.V_SQL} AS w FROM alts a JOIN chains USING (chain_id)),
pooled AS (SELECT chain_id, exp(w - max(w) OVER (PARTITION BY chain_id)) AS x, choice, user_type FROM pool),
q AS (SELECT *, x / sum(x) OVER (PARTITION BY chain_id) AS p FROM pooled),
lls AS (SELECT user_type, sum(ln(p)) AS ll0 FROM q WHERE choice = 1 GROUP BY 1),
own AS (SELECT user_type, count(*) AS chains, sum(ln(p)) AS ll FROM scored WHERE choice = 1 GROUP BY 1),
s AS (SELECT user_type, chains, greatest(2 * (ll - ll0), 2 * (ll0 - ll)) AS x FROM own JOIN lls USING (user_type))
SELECT user_type, chains, round(x, 4) AS statistic, 4 AS dof, round(exp(-x / 2) * (1 + x / 2), 9) AS p FROM s""")
def type_likelihood_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each type's own coefficients against the pooled ones, the likelier set counting as the larger model."""
    own = d.scored(spark, sf_dir)
    both = with_probability(own.withColumn("w", utility(d.POOLED)), "w", "p_pooled").where("choice = 1")
    lls = both.groupBy("user_type").agg(F.count("*").alias("chains"), F.sum(F.log("p")).alias("a"), F.sum(F.log("p_pooled")).alias("b"))
    test = modeltests.likelihood_ratio(F.greatest("a", "b"), F.least("a", "b"), F.lit(len(d.POOLED)))
    rows = lls.select("user_type", "chains", test.alias("t"))
    return rows.select("user_type", "chains", F.round("t.statistic", 4).alias("statistic"), "t.dof", F.round("t.p", 9).alias("p"))


@query(f"""WITH {d.SCORED_SQL},
k AS (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY round(p, 9) DESC, alt_id) AS place FROM scored)
SELECT user_type, count(*) AS chains, {", ".join(f"round(avg(CASE WHEN place <= {k} THEN 1 ELSE 0 END), 6) AS top_{k}" for k in (1, 2, 3))}
FROM k WHERE choice = 1 GROUP BY 1""")
def top_k_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = modeltests.top_k_accuracy(d.scored(spark, sf_dir).withColumn("p", F.round("p", 9)), "p", (1, 2, 3), "user_type")
    return rows.select("user_type", "chains", *(r6(f"top_{k}", f"top_{k}") for k in (1, 2, 3)))


@query("""WITH c AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*) AS n FROM orders GROUP BY 1, 2),
m AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS t FROM c),
s AS (SELECT sum(n * n / (na * nb / t)) - any_value(t) AS x, count(DISTINCT a) AS ra, count(DISTINCT b) AS rb, any_value(t) AS t FROM m),
h AS (SELECT *, x / 2 AS y, (ra - 1) * (rb - 1) AS dof FROM s)
SELECT round(x, 4) AS chi2, CAST(dof AS INT) AS dof, round(sqrt(x / (t * least(ra - 1, rb - 1))), 6) AS cramers_v,
  round(exp(-y) * list_sum(list_transform(range(0, dof // 2), lambda i: pow(y, i) / gamma(i + 1))), 9) AS p FROM h""")
def class_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Association of two categories with its p value. (The SQL has the closed form of an even number of degrees of freedom.)"""
    found = modeltests.association(d.read(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus")
    return found.select(F.round("chi2", 4).alias("chi2"), F.col("dof").cast("int").alias("dof"), r6("cramers_v", "cramers_v"), F.round("p", 9).alias("p"))


@query(None)
def nested_model_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihood ratio, Wald and Hausman tests of fitted logits; held to a plain fit by a test."""
    rows = d.alternatives(spark, sf_dir)
    return modeltests.nested_tests(spark, rows, list(d.POOLED), ["n_transfer", "d_subway"], F.col("alt_id") % 3 == 2)


#: 22 settings of the router: walking reluctance, seconds of a transfer, and whether subways are preferred.
SETTINGS = [{"t_ride": 1.0, "t_walk": 1.0 + 0.25 * i, "n_transfer": 5.0 * (i % 7), "d_subway": -3.0 * (i % 2)} for i in range(22)]


def _cost_sql(i: int) -> str:
    return " + ".join(f"{c} * ({w})" for c, w in SETTINGS[i].items())


@query(f"""WITH {d.ALTS_SQL},
weights AS (SELECT o_orderkey AS chain_id, 1 + o_custkey % 3 AS weight FROM orders),
c AS ({" UNION ALL ".join(f"SELECT chain_id, {i} AS setting, min(({_cost_sql(i)}, alt_id, sim, choice)) AS k FROM alts GROUP BY 1" for i in range(len(SETTINGS)))})
SELECT setting, count(*) AS chains, round(sum(k[3] * weight) / sum(weight), 6) AS sim, round(sum(k[4] * weight) / sum(weight), 6) AS exact,
  round(sum(k[1] * weight) / sum(weight), 4) AS cost FROM c JOIN weights USING (chain_id) GROUP BY 1""")
def setting_objectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the cheapest alternatives of 22 settings are like; the alternatives are scanned once."""
    rows = d.alternatives(spark, sf_dir).withColumnRenamed("choice", "exact")
    weights = d.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chain_id"), (1 + F.col("o_custkey") % 3).cast("double").alias("weight"))
    got = settings.objectives_by_setting(rows, SETTINGS, list(d.POOLED), weights)
    return got.select("setting", "chains", r6("sim", "sim"), r6("exact", "exact"), F.round("cost", 4).alias("cost"))


_COVARIATES = ["morning", "pricey"]
#: Parameters of two classes: coefficients of each, then intercept and coefficients of membership in the first.
LATENT_SETS = [
    [-0.08, -0.02, -0.3, 0.2, -0.01, -0.1, -0.9, 0.0, 0.4, -0.7, 0.3],
    [0.0, 0.0, 0.0, 0.0, -0.05, -0.05, -0.5, 0.1, 0.0, 0.0, 0.0],
    [-0.2, 0.1, 0.4, -1.0, 0.05, -0.3, 0.2, 0.6, -2.0, 1.5, 0.5],
]


def _class_sql(at: int, i: int) -> str:
    return " + ".join(f"{n} * ({b})" for n, b in zip(d.POOLED, LATENT_SETS[at][4 * i : 4 * i + 4], strict=True))


def _member_sql(at: int) -> str:
    a, m, p = LATENT_SETS[at][8:]
    return f"1 / (1 + exp(-({a} + {m} * morning + {p} * pricey)))"


@query(f"""WITH {d.ALTS_SQL}, {d.CHAINS_SQL},
x AS (SELECT a.*, CASE WHEN board_s < 43200 THEN 1.0 ELSE 0.0 END AS morning, CASE WHEN user_type IN ('1', '2') THEN 1.0 ELSE 0.0 END AS pricey
  FROM alts a JOIN chains c USING (chain_id)),
v AS ({" UNION ALL ".join(f"SELECT {at} AS set_, chain_id, choice, {_member_sql(at)} AS pi, {_class_sql(at, 0)} AS v0, {_class_sql(at, 1)} AS v1 FROM x" for at in range(3))}),
e AS (SELECT *, exp(v0 - max(v0) OVER w) AS e0, exp(v1 - max(v1) OVER w) AS e1 FROM v WINDOW w AS (PARTITION BY set_, chain_id)),
p AS (SELECT *, pi * e0 / sum(e0) OVER w + (1 - pi) * e1 / sum(e1) OVER w AS p FROM e WINDOW w AS (PARTITION BY set_, chain_id))
SELECT set_ AS parameters, round(sum(ln(p)), 3) AS ll FROM p WHERE choice = 1 GROUP BY 1""")
def latent_likelihoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likelihoods of several sets of parameters of two latent classes in one pass over the chains, as a fit evaluates its starts."""
    from_chain = d.chains(spark, sf_dir).select(
        "chain_id",
        F.when(F.col("board_s") < 43_200, 1.0).otherwise(0.0).alias("morning"),
        F.when(F.col("user_type").isin("1", "2"), 1.0).otherwise(0.0).alias("pricey"),
    )
    chains = latent.packed(d.alternatives(spark, sf_dir).join(from_chain, "chain_id"), list(d.POOLED), _COVARIATES)
    ll, _ = latent.evaluate(chains, list(d.POOLED), _COVARIATES, 2, LATENT_SETS)
    return spark.createDataFrame([(i, round(float(x), 3)) for i, x in enumerate(ll)], "parameters int, ll double")


#: Parameters of a mixed logit: fixed coefficients, mean of the transfers' coefficient, logarithm of its spread.
MIXED, _DRAWS = [-0.03, -0.05, 0.25, -0.6, -0.4], 12


@query(f"""WITH {d.ALTS_SQL}, draws AS (SELECT unnest({mixed.normal_draws(_DRAWS, 1)[:, 0].tolist()}) AS z),
v AS (SELECT chain_id, choice, z, t_ride * ({MIXED[0]}) + t_walk * ({MIXED[1]}) + d_subway * ({MIXED[2]})
  + n_transfer * ({MIXED[3]} + exp({MIXED[4]}) * z) AS v FROM alts, draws),
e AS (SELECT *, exp(v - max(v) OVER (PARTITION BY chain_id, z)) AS e FROM v),
p AS (SELECT *, e / sum(e) OVER (PARTITION BY chain_id, z) AS p FROM e),
c AS (SELECT chain_id, ln(avg(p) + 1e-10) AS l FROM p WHERE choice = 1 GROUP BY 1) SELECT count(*) AS chains, round(sum(l), 3) AS ll FROM c""")
def mixed_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The simulated likelihood of a mixed logit at given parameters."""
    fixed, random = ["t_ride", "t_walk", "d_subway"], ["n_transfer"]
    rows = mixed.grouped(d.alternatives(spark, sf_dir), *fixed, *random)
    chains, ll, _ = mixed.totals(rows, fixed, random, MIXED, mixed.normal_draws(_DRAWS, 1))
    return spark.createDataFrame([(chains, round(float(ll), 3))], "chains long, ll double")
