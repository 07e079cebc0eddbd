"""Potential of each outlet: floor, model or peers, season and constraint, within the ceilings; then the budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandry.config import BUDGET, POTENTIAL
from demandry.functions.exprs import ceil_to, clip, greatest_or_null, least_or_null, literal_map
from demandry.operators import budget as b
from demandry.operators import panel as p
from demandry.plans import features as f
from demandry.plans import views as v
from demandry.session import cut


def uplift(df: DataFrame) -> DataFrame:
    """Adds uplift = 1 + share * clip((censoring + plateau) / 2)."""
    return df.withColumn("uplift", 1 + POTENTIAL.uplift * clip(0.5 * F.col("censoring_score") + 0.5 * F.col("plateau_norm"), 0.0, 1.0))


def combine(df: DataFrame) -> DataFrame:
    """Adds floor, ceiling, raw, scaled, potential and winner.

    df has vol_max, stage_a, peer_p85, peer_p99, physical_max, capacity_breached, season and uplift. The ceiling is the
    peers' and, where coolers were not exceeded already, the physical one; the floor wins over both. Null inputs give null.
    """
    own = df.withColumn("floor", POTENTIAL.floor * F.col("vol_max"))
    peer_cap = POTENTIAL.ceiling * F.col("peer_p99")
    own = own.withColumn("ceiling", F.when(F.col("capacity_breached") == 1, peer_cap).otherwise(least_or_null(peer_cap, F.col("physical_max"))))
    own = own.withColumn("raw", greatest_or_null(F.col("floor"), F.col("stage_a"), F.col("peer_p85")))
    own = own.withColumn("scaled", F.col("raw") * F.col("season") * F.col("uplift"))
    own = own.withColumn("potential", greatest_or_null(least_or_null(F.col("scaled"), F.col("ceiling")), F.col("floor")))
    winner = F.when((F.col("floor") >= F.col("stage_a")) & (F.col("floor") >= F.col("peer_p85")), "floor").when(F.col("stage_a") >= F.col("peer_p85"), "model").otherwise("peer")
    return own.withColumn("winner", F.when(F.col("raw").isNotNull(), winner))


def seasoned(df: DataFrame) -> DataFrame:
    """Adds the season's factor of the label."""
    return df.withColumn("season", F.element_at(literal_map(POTENTIAL.season), F.col("season_label")))


def judged(df: DataFrame) -> DataFrame:
    """The diagnostic table of outlets with season and all that `combine` and `uplift` read."""
    return combine(uplift(df)).withColumn("constraint_type", F.when(F.col("censoring_score") > POTENTIAL.supply_bound, "supply").otherwise("demand"))


def scored_features(table: DataFrame) -> DataFrame:
    """`scored` of the feature table, for those who have that already; stage_a is its column, or the P95 without one."""
    return judged(seasoned(table if "stage_a" in table.columns else table.withColumn("stage_a", F.col("vol_p95"))))


def scored(spark: SparkSession, sf_dir: str, stage_a: DataFrame | None = None, own: DataFrame | None = None) -> DataFrame:
    """The diagnostic table. stage_a (outlet_id, stage_a) is the model's answer; without one the outlet's own P95 stands in. own is
    `profile_of`, where the caller reads it as well."""
    own = f.transactional(f.profile_of(spark, sf_dir) if own is None else own)
    who = f.members(spark, sf_dir, own)
    peer = f.peers(who.join(own.select("outlet_id", "vol_mean", "volumes"), "outlet_id")).select("outlet_id", "cluster_size", "peer_rank", "peer_p85", "peer_p99")
    own = own.drop("distributor_id", "volumes", "hit_rate")
    season = f.temporal(who.select("outlet_id", "distributor_id"), v.seasonality(spark, sf_dir).where("label != 'Unknown'"))
    joined = who.join(own, "outlet_id").join(peer, "outlet_id").join(season, "outlet_id")
    joined = joined.join(stage_a, "outlet_id", "left") if stage_a is not None else joined.withColumn("stage_a", F.col("vol_p95"))
    return judged(f.physical(seasoned(joined)))


def predictions(diagnostic: DataFrame) -> DataFrame:
    """(outlet_id, max_monthly_litres): rounded up to two digits, so never below the floor."""
    return diagnostic.select("outlet_id", ceil_to(F.col("potential")).alias("max_monthly_litres"))


def candidates(diagnostic: DataFrame) -> DataFrame:
    """(outlet_id, ..., gap, k, spend_type) of the budget's province."""
    supply = F.col("constraint_type") == "supply"
    return diagnostic.where(F.col("province") == BUDGET.province).select(
        "outlet_id", "distributor_id", "outlet_type", "outlet_size", F.col("vol_mean").alias("recent_actual"), "potential", F.greatest(F.col("potential") - F.col("vol_mean"), F.lit(0.0)).alias("gap"), "constraint_type",
        F.when(supply, BUDGET.k_supply).otherwise(BUDGET.k_demand).alias("k"),
        F.when(supply & (F.col("coolers") <= 1), "cooler").when(supply, "merchandising").otherwise("discount").alias("spend_type"),
    )


def allocate(frame: DataFrame, exact: bool = True) -> DataFrame:
    """frame with spend (two digits, halves to even) and increment (of the unrounded spend)."""
    frame = cut(frame)
    spend = b.waterfill(frame, BUDGET.total, BUDGET.cap) if exact else b.greedy(frame, BUDGET.total, BUDGET.cap, BUDGET.step)
    joined = frame.join(spend, "outlet_id")
    return joined.withColumn("increment", b.response(F.col("gap"), F.col("k"), F.col("spend"))).withColumn("spend", F.bround("spend", 2))
