"""Many parameter settings over one set of alternatives, in one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Settings of one aggregation; more than that are dealt over several.
TOGETHER = 64


def objectives_by_setting(alternatives: DataFrame, settings: list[dict[str, float]], components: list[str], weights: DataFrame | None = None) -> DataFrame:
    """(setting, chains, sim, exact, cost): for each setting the weighted means over the chains of what its cheapest alternative has.

    alternatives: chain_id, alt_id, sim, exact and the cost components; a setting gives each component's weight, and an alternative costs the sum. An
    alternative's components are read once: the costs of all settings are an array, and the cheapest ones an array of minima for each chain
    (ties: the smaller alt_id), which combine before the shuffle. weights: (chain_id, weight), 1 without one. Alternatives with an unknown cost are
    never picked; a chain without a known one in a setting doesn't count there.
    """
    weighed = None
    for first in range(0, len(settings), TOGETHER):
        own = settings[first : first + TOGETHER]
        picks = []
        for i, s in enumerate(own):
            cost = sum((F.col(c) * float(s.get(c, 0.0)) for c in components), F.lit(0.0))
            picks.append(F.min(F.when(cost.isNotNull(), F.struct(cost.alias("cost"), "alt_id", "sim", "exact"))).alias(f"s{i}"))
        chains = alternatives.groupBy("chain_id").agg(*picks)
        if weights is not None:
            chains = chains.join(weights.select("chain_id", "weight"), "chain_id", "left")
        w = F.coalesce(F.col("weight"), F.lit(1.0)) if weights is not None else F.lit(1.0)
        sums = []
        for i in range(len(own)):
            known = F.when(F.col(f"s{i}").isNotNull(), w)
            mean = lambda c: (F.sum(F.col(f"s{i}.{c}") * w) / F.sum(known)).alias(c)  # noqa: B023, E731
            sums.append(F.struct(F.lit(first + i).alias("setting"), F.count(f"s{i}").alias("chains"), mean("sim"), mean("exact"), mean("cost")))
        rows = chains.agg(F.array(*sums).alias("all")).select(F.explode("all").alias("r")).select("r.*")
        weighed = rows if weighed is None else weighed.union(rows)
    return weighed
