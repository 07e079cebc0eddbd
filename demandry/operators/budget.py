"""A fixed budget over outlets whose response gap * (1 - exp(-k * spend)) flattens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandry.functions.exprs import exact_sum
from demandry.operators.ranks import running


def greedy(candidates: DataFrame, budget: float, cap: float, step: float) -> DataFrame:
    """(outlet_id, spend): steps in the order of their marginal gain, ties to the smaller id.

    The response is concave, so filling the best marginal step by step equals taking the best steps of all, and an
    outlet's steps are taken in turn. Rows of no gain get 0.
    """
    steps = int(-(-cap // step))
    exploded = candidates.where("gap > 0").select("outlet_id", "gap", "k", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("j"))
    marginal = F.col("gap") * F.col("k") * F.exp(-F.col("k") * step * F.col("j"))
    best = exploded.withColumn("marginal", marginal).orderBy(F.desc("marginal"), "outlet_id", "j").limit(int(budget // step))
    taken = best.groupBy("outlet_id").agg(F.sum(F.least(F.lit(float(step)), F.lit(float(cap)) - F.col("j") * step)).alias("spend"))
    return candidates.select("outlet_id").join(taken, "outlet_id", "left").select("outlet_id", F.coalesce("spend", F.lit(0.0)).alias("spend"))


def waterfill(candidates: DataFrame, budget: float, cap: float) -> DataFrame:
    """(outlet_id, spend): the optimum spend = clip((ln(gap k) - level) / k, 0, cap) whose sum is the budget.

    The sum is linear in the level between the points where an outlet enters or fills up. With the sums of slopes and of
    slopes times points over the points above, it is known at each point; the level lies below the last point that the
    budget reaches.
    """
    x = candidates.where("gap > 0").withColumn("top", F.log(F.col("gap") * F.col("k")))
    enters, fills = F.struct(F.col("top").alias("at"), (1 / F.col("k")).alias("slope")), F.struct((F.col("top") - F.col("k") * cap).alias("at"), (-1 / F.col("k")).alias("slope"))
    points = x.select(F.explode(F.array(enters, fills)).alias("b")).select("b.*").groupBy("at").agg(F.sum("slope").alias("slope"))
    sums = running(points, [F.col("at").desc()], rate=F.col("slope"), weighed=F.col("slope") * F.col("at"))
    sums = sums.withColumn("rate", F.col("rate") + F.col("slope")).withColumn("weighed", F.col("weighed") + F.col("slope") * F.col("at"))
    last = sums.where(F.col("weighed") - F.col("at") * F.col("rate") <= budget).agg(F.min_by(F.struct("rate", "weighed"), "at").alias("s"))
    level = last.select(F.when(F.col("s.rate") > 1e-6, (F.col("s.weighed") - budget) / F.col("s.rate")).alias("level"))
    spend = F.when(F.col("level").isNull(), F.lit(float(cap))).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(float(cap)), (F.col("top") - F.col("level")) / F.col("k"))))
    filled = x.crossJoin(F.broadcast(level)).select("outlet_id", spend.alias("spend"))  # level is one row
    return candidates.select("outlet_id").join(filled, "outlet_id", "left").select("outlet_id", F.coalesce("spend", F.lit(0.0)).alias("spend"))


def response(gap, k, spend):
    return gap * (1 - F.exp(-k * spend))


def summary(allocated: DataFrame, by: str) -> DataFrame:
    """Funded outlets, spend and increment of each group; funded is more than 1."""
    funded = allocated.where("spend > 1").groupBy(by)
    return funded.agg(F.count("*").alias("outlets"), exact_sum(F.col("spend")).alias("spend"), F.round(F.sum(F.col("increment").cast("decimal(18,6)")).cast("double"), 3).alias("increment"))


def compare(exact: DataFrame, greedy: DataFrame) -> DataFrame:
    """One row: the increments of both solutions and the share of the exact one that the greedy one reaches."""
    both = exact.select("outlet_id", F.col("increment").alias("exact")).join(greedy.select("outlet_id", F.col("increment").alias("greedy")), "outlet_id")
    total = lambda c: F.sum(F.col(c).cast("decimal(18,6)")).cast("double")
    return both.agg(F.count("*").alias("outlets"), F.round(total("exact"), 3).alias("exact"), F.round(total("greedy"), 3).alias("greedy"), F.round(total("greedy") / F.greatest(total("exact"), F.lit(1e-9)), 6).alias("ratio"))
