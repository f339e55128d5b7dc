"""Queries on choice sets, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.functions.times import is_peak
from farebox.operators import choice as ch
from farebox.operators import sampling
from farebox.operators.journeys import left_closed
from farebox.plans import derive as d

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c, name: str):
    return F.round(c, 6).alias(name)


@query(f"WITH {d.SCORED_SQL} SELECT chain_id, alt_id, round(v, 6) AS v, round(p, 6) AS p, choice FROM scored")
def mnl_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.scored(spark, sf_dir).select("chain_id", "alt_id", r6("v", "v"), r6("p", "p"), "choice")


_PICKS_SQL = f"""{d.SCORED_SQL},
o AS (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY cost, alt_id) AS rc, row_number() OVER (PARTITION BY chain_id ORDER BY v DESC, alt_id) AS rv,
             row_number() OVER (PARTITION BY chain_id ORDER BY sim DESC, alt_id) AS rs FROM scored),
picks AS (SELECT chain_id, any_value(user_type) AS user_type, any_value(board_s) AS board_s, any_value(n_alts) AS n_alts, max(CASE
  WHEN rc = 1 THEN alt_id END) AS cost_alt, max(CASE WHEN rc = 1 THEN sim END) AS cost_sim,
  max(CASE WHEN rc = 1 THEN n_transfer END) AS transfers, max(CASE WHEN rv = 1 THEN alt_id END) AS v_alt, max(CASE WHEN rv = 1 THEN sim END) AS v_sim,
  max(CASE WHEN rs = 1 THEN sim END) AS best_sim, sum(p * sim) AS f1
  FROM o GROUP BY chain_id)"""


def picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each chain: what the cheapest, the most useful and the most similar alternative are. One aggregation finds all three."""
    cheap = F.min_by(F.struct("alt_id", "sim", "n_transfer"), F.struct("cost", "alt_id"))
    useful = ch.best("_as", F.col("v"))
    rows = d.scored(spark, sf_dir).withColumn("_as", F.struct("alt_id", "sim"))
    found = rows.groupBy("chain_id").agg(F.first("user_type").alias("user_type"), F.first("board_s").alias("board_s"), F.first("n_alts").alias("n_alts"), cheap.alias("c"), useful.alias("u"), F.max("sim").alias("best_sim"), F.sum(F.col("p") * F.col("sim")).alias("f1"))
    return found.select("chain_id", "user_type", "board_s", "n_alts", F.col("c.alt_id").alias("cost_alt"), F.col("c.sim").alias("cost_sim"), F.col("c.n_transfer").alias("transfers"), F.col("u.alt_id").alias("v_alt"), F.col("u.sim").alias("v_sim"), "best_sim", "f1")


_WAYS = [("cost_sim", "cost"), ("v_sim", "mnl"), ("best_sim", "best"), ("f1", "f1")]


@query(f"WITH {_PICKS_SQL} SELECT user_type, count(*) AS chains, round(avg(cost_sim), 6) AS cost_mean, round(avg(v_sim), 6) AS mnl_mean, round(avg(best_sim), 6) AS best_mean, round(avg(f1), 6) AS f1_mean FROM picks GROUP BY user_type")
def three_way_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picks(spark, sf_dir).groupBy("user_type").agg(F.count("*").alias("chains"), *(r6(F.avg(c), f"{n}_mean") for c, n in _WAYS))


@query(f"""WITH {_PICKS_SQL}, b AS (SELECT *, CASE WHEN transfers >= 3 THEN '3+' ELSE CAST(CAST(transfers AS INT) AS VARCHAR) END AS transfer_class,
  CASE WHEN n_alts = 1 THEN '1' WHEN n_alts = 2 THEN '2' WHEN n_alts <= 4 THEN '3-4' ELSE '5+' END AS size_class,
  CASE WHEN board_s // 3600 IN (7, 8, 18, 19) THEN 1 ELSE 0 END AS peak FROM picks)
  SELECT user_type, transfer_class, size_class, peak, count(*) AS chains, round(avg(cost_sim), 6) AS cost_mean, round(avg(v_sim), 6) AS mnl_mean, round(avg(best_sim), 6) AS best_mean
  FROM b GROUP BY GROUPING SETS ((user_type), (transfer_class), (size_class), (peak), ())""")
def ranking_breakdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All breakdowns of the ranking in one pass."""
    rows = picks(spark, sf_dir).withColumns({
        "transfer_class": F.when(F.col("transfers") >= 3, "3+").otherwise(F.col("transfers").cast("int").cast("string")),
        "size_class": F.when(F.col("n_alts") == 1, "1").when(F.col("n_alts") == 2, "2").when(F.col("n_alts") <= 4, "3-4").otherwise("5+"),
        "peak": is_peak(F.col("board_s")).cast("int"),
    })
    by = [F.col(c) for c in ("user_type", "transfer_class", "size_class", "peak")]
    return rows.groupingSets([[c] for c in by] + [[]], *by).agg(F.count("*").alias("chains"), *(r6(F.avg(c), f"{n}_mean") for c, n in _WAYS[:3]))


@query(f"""WITH {_PICKS_SQL} SELECT user_type, count(*) AS chains, CAST(count(*) FILTER (cost_alt = v_alt) AS BIGINT) AS agree, count(*) FILTER (v_sim > cost_sim) AS win,
  count(*) FILTER (v_sim < cost_sim) AS lose, count(*) FILTER (v_sim = cost_sim) AS tie FROM picks GROUP BY user_type""")
def agreement_win_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda c, name: F.count_if(c).alias(name)
    v, c = F.col("v_sim"), F.col("cost_sim")
    return picks(spark, sf_dir).groupBy("user_type").agg(F.count("*").alias("chains"), n(F.col("cost_alt") == F.col("v_alt"), "agree"), n(v > c, "win"), n(v < c, "lose"), n(v == c, "tie"))


@query(f"""WITH {_PICKS_SQL} SELECT user_type, round(avg(f1), 6) AS f1, round(sum(f1 * w) / sum(w), 6) AS f1_weighted, round(sum(w), 6) AS weights
  FROM (SELECT *, CAST(CASE user_type WHEN '1' THEN 2.0 WHEN '3' THEN 0.5 ELSE 1.0 END AS DOUBLE) * n_alts AS w FROM picks) GROUP BY user_type""")
def expected_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similarity that the probabilities let expect, plain and weighted; types without a weight count once."""
    weights = spark.createDataFrame([("1", 2.0), ("3", 0.5)], "user_type string, weight double")
    rows = picks(spark, sf_dir).join(F.broadcast(weights), "user_type", "left").withColumn("w", F.coalesce("weight", F.lit(1.0)) * F.col("n_alts"))
    return rows.groupBy("user_type").agg(r6(F.avg("f1"), "f1"), r6(F.sum(F.col("f1") * F.col("w")) / F.sum("w"), "f1_weighted"), r6(F.sum("w"), "weights"))


@query(f"""WITH {d.SCORED_SQL}, t AS (SELECT *, max(v) OVER (PARTITION BY chain_id) AS mv FROM scored),
  h AS (SELECT chain_id, any_value(user_type) AS user_type, max(CASE WHEN v = mv AND choice = 1 THEN 1 ELSE 0 END) AS hit, sum(CASE WHEN v = mv THEN 1
  ELSE 0 END) AS tied, sum(p * choice) AS pc FROM t GROUP BY chain_id)
  SELECT user_type, round(avg(hit), 6) AS hit_rate, count(*) FILTER (tied > 1) AS tied_chains, round(avg(pc), 6) AS mean_p FROM h GROUP BY user_type""")
def hit_rate_any_tie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hit is any alternative of the largest utility that is the chosen one."""
    rows = d.scored(spark, sf_dir).withColumn("top", F.col("v") == F.max("v").over(ch.of_chain()))
    per = rows.groupBy("chain_id").agg(F.first("user_type").alias("user_type"), F.bool_or(F.col("top") & (F.col("choice") == 1)).cast("int").alias("hit"), F.count_if("top").alias("tied"), F.sum(F.col("p") * F.col("choice")).alias("pc"))
    return per.groupBy("user_type").agg(r6(F.avg("hit"), "hit_rate"), F.count_if(F.col("tied") > 1).alias("tied_chains"), r6(F.avg("pc"), "mean_p"))


@query(f"""WITH {d.SCORED_SQL}, s AS (SELECT count(*) AS chains, sum(ln(p)) AS ll, sum(-ln(n_alts)) AS ll0 FROM scored WHERE choice = 1)
  SELECT chains, round(ll, 4) AS ll, round(ll0, 4) AS ll0, round(1 - ll / ll0, 6) AS rho2, round(1 - (ll - 4) / ll0, 6) AS rho2_adj,
  round(8 - 2 * ll, 4) AS aic, round(4 * ln(chains) - 2 * ll, 4) AS bic FROM s""")
def fit_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ch.fit_statistics(d.scored(spark, sf_dir), 4)
    return s.select("chains", *(F.round(c, 6 if "rho" in c else 4).alias(c) for c in ("ll", "ll0", "rho2", "rho2_adj", "aic", "bic")))


_STEPS = [0.5, 0.6, 0.7, 0.8, 0.9, 0.95]


@query(f"WITH {d.ALTS_SQL}, b AS (SELECT chain_id, max(sim) AS best FROM alts GROUP BY chain_id), t AS (SELECT unnest({_STEPS}) AS threshold) SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (best >= threshold) AS chains, count(*) AS n FROM b, t GROUP BY threshold")
def threshold_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chains would stay at each threshold: one aggregation, then one row for each step."""
    best = d.alternatives(spark, sf_dir).groupBy("chain_id").agg(F.max("sim").alias("best"))
    one = best.agg(F.count("*").alias("n"), *(F.count_if(F.col("best") >= t).alias(f"t{i}") for i, t in enumerate(_STEPS)))
    steps = F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"t{i}").alias("chains")) for i, t in enumerate(_STEPS)))
    return one.select("n", F.explode(steps).alias("s")).select("s.*", "n")


@query(f"WITH {d.ALTS_SQL} SELECT chain_id, alt_id, choice, round(sim, 6) AS sim, round(max(sim) OVER (PARTITION BY chain_id), 6) AS best_sim FROM alts QUALIFY max(sim) OVER (PARTITION BY chain_id) >= 0.7")
def choice_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = d.alternatives(spark, sf_dir).withColumn("best_sim", F.max("sim").over(ch.of_chain())).where("best_sim >= 0.7")
    return rows.select("chain_id", "alt_id", "choice", r6("sim", "sim"), r6("best_sim", "best_sim"))


@query(f"""WITH {d.ALTS_SQL}, ok AS (SELECT chain_id FROM alts GROUP BY chain_id HAVING sum(choice) = 1 AND count(*) > 1 AND count(*) FILTER (t_ride > 48 OR (t_walk >= 8 AND n_transfer = 3)) = 0)
  SELECT chain_id, alt_id, round(t_ride / 60.0, 6) AS ride_minutes, choice FROM alts WHERE chain_id IN (SELECT chain_id FROM ok)""")
def model_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains without outliers, with one choice and several alternatives."""
    outlier = (F.col("t_ride") > 48) | ((F.col("t_walk") >= 8) & (F.col("n_transfer") == 3))
    rows = ch.clean_chains(d.alternatives(spark, sf_dir), outlier)
    return rows.select("chain_id", "alt_id", r6(F.col("t_ride") / 60.0, "ride_minutes"), "choice")


@query(f"""WITH {d.ALTS_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY chain_id, n_transfer ORDER BY alt_id) AS k FROM alts)
  SELECT chain_id, alt_id AS old_alt, row_number() OVER (PARTITION BY chain_id ORDER BY t_ride, alt_id) - 1 AS alt_id FROM f WHERE k = 1""")
def dedup_and_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first alternative of each route pattern, numbered anew by duration."""
    from pyspark.sql.window import Window

    rows = d.alternatives(spark, sf_dir)
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("chain_id", "n_transfer").orderBy("alt_id"))).where("k = 1")
    turn = F.row_number().over(ch.of_chain().orderBy("t_ride", "alt_id")) - 1
    return first.select("chain_id", F.col("alt_id").alias("old_alt"), turn.cast("long").alias("alt_id"))


@query(f"""WITH {d.SCORED_SQL} SELECT CASE WHEN p < 0.3 THEN 0 WHEN p < 0.5 THEN 1 WHEN p < 0.7 THEN 2 WHEN p < 0.9 THEN 3 ELSE 4 END AS bin, count(*) AS n, round(avg(sim), 6) AS mean_sim
  FROM scored WHERE choice = 1 GROUP BY 1""")
def probability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = d.scored(spark, sf_dir).where("choice = 1").withColumn("bin", left_closed(F.col("p"), [0, 0.3, 0.5, 0.7, 0.9, 1.01]))
    return rows.groupBy("bin").agg(F.count("*").alias("n"), r6(F.avg("sim"), "mean_sim"))


_NAMES = list(d.POOLED)
_GRAD_SQL = ", ".join(f"round(sum((choice - p) * {n}), 4) AS g_{n}" for n in _NAMES)


@query(f"WITH {d.ALTS_SQL}, v AS (SELECT *, {d.V_SQL} AS v FROM alts), e AS (SELECT *, exp(v - max(v) OVER (PARTITION BY chain_id)) AS x FROM v), s AS (SELECT *, x / sum(x) OVER (PARTITION BY chain_id) AS p FROM e) SELECT round(sum(CASE WHEN choice = 1 THEN ln(p) END), 4) AS ll, {_GRAD_SQL} FROM s")
def mnl_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ch.gradient(d.alternatives(spark, sf_dir), d.POOLED)
    return g.select(*(F.round(c, 4).alias(c) for c in ("ll", *(f"g_{n}" for n in _NAMES))))


@query(None)
def mnl_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = ch.fit_logit(d.alternatives(spark, sf_dir), _NAMES)
    return spark.createDataFrame([(n, v["beta"], v["se"], v["t"], v["p"]) for n, v in fit.items()], "name string, beta double, se double, t double, p double")


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(CAST(o_orderkey AS VARCHAR)),
  o_orderkey) AS k, count(*) OVER (PARTITION BY o_orderstatus) AS size, count(*) OVER () AS total FROM orders),
  t AS (SELECT *, count(*) OVER (PARTITION BY o_orderstatus) AS taken, count(*) OVER () AS drawn FROM o WHERE k <= floor(CASE o_orderstatus
  WHEN 'F' THEN 0.5 WHEN 'O' THEN 0.4 WHEN 'P' THEN 0.1 ELSE 0 END * 100))
  SELECT o_orderkey, o_orderstatus, round((size / total) / (taken / drawn), 6) AS weight FROM t""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = d.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return sampling.stratified_sample(orders, "o_orderstatus", "o_orderkey", {"F": 0.5, "O": 0.4, "P": 0.1}, 100).select("o_orderkey", "o_orderstatus", r6("weight", "weight"))


@query("SELECT o_orderkey AS chain_id, CASE WHEN CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < 0.8 THEN 'train' ELSE 'test' END AS part FROM orders")
def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chain_id"), F.when(sampling.split_share("o_orderkey") < 0.8, "train").otherwise("test").alias("part"))


@query("""WITH c AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*) AS n FROM orders GROUP BY 1, 2), m AS (SELECT *,
  sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS t FROM c),
  s AS (SELECT sum(n * n / (na * nb / t)) - any_value(t) AS chi2, count(DISTINCT a) AS ra, count(DISTINCT b) AS rb, any_value(t) AS t FROM m)
  SELECT round(chi2, 4) AS chi2, CAST((ra - 1) * (rb - 1) AS BIGINT) AS dof, round(sqrt(chi2 / (t * least(ra - 1, rb - 1))), 6) AS cramers_v FROM s""")
def contingency_chi2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    cells = d.read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("a"), F.col("o_orderstatus").alias("b")).agg(F.count("*").alias("n"))
    over = lambda *by: F.sum("n").over(Window.partitionBy(*by))
    rows = cells.select("a", "b", "n", over("a").alias("na"), over("b").alias("nb"), over().alias("t"))
    s = rows.agg((F.sum(F.col("n") * F.col("n") / (F.col("na") * F.col("nb") / F.col("t"))) - F.max("t")).alias("chi2"), F.countDistinct("a").alias("ra"), F.countDistinct("b").alias("rb"), F.max("t").alias("t"))
    return s.select(F.round("chi2", 4).alias("chi2"), ((F.col("ra") - 1) * (F.col("rb") - 1)).alias("dof"), r6(F.sqrt(F.col("chi2") / (F.col("t") * F.least(F.col("ra") - 1, F.col("rb") - 1))), "cramers_v"))
