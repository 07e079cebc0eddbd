"""The feature table: one row per outlet, built from the panel, the master, places and the calendar."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandry.config import DECAY, DOMAIN, POTENTIAL
from demandry.functions.exprs import clip, one_hot, province, tier
from demandry.operators import panel as p
from demandry.operators import spatial as s
from demandry.operators.ranks import pct_ranks, quantiles, running
from demandry.plans import silver
from demandry.plans import views as v
from demandry.session import cut, stored

SIZE_ORDER = {name: k + 1 for k, name in enumerate(DOMAIN.sizes)}


def structural(master: DataFrame, stats: DataFrame) -> DataFrame:
    """One-hot size and type, ordinal size, litres per cooler and coolers per litre."""
    joined = master.join(stats.select("outlet_id", "vol_mean"), "outlet_id", "left")
    ordinal = reduce(lambda c, x: F.when(F.col("outlet_size") == x[0], x[1]).otherwise(c), SIZE_ORDER.items(), F.lit(0))
    return joined.select(
        "outlet_id", "coolers", *one_hot(F.col("outlet_size"), DOMAIN.sizes, "size"), *one_hot(F.col("outlet_type"), DOMAIN.types, "type"), ordinal.alias("size_ordinal"),
        (F.col("vol_mean") / F.greatest("coolers", F.lit(1))).alias("volume_per_cooler"), (F.col("coolers") / F.greatest("vol_mean", F.lit(1.0))).alias("cooler_per_volume"),
    )


def profile_of(spark: SparkSession, sf_dir: str, year: int = 2000, timed: bool = False) -> DataFrame:
    """Each outlet's own months as one row (`panel.profile`), cut off from the sales that it sums up: every feature reads it."""
    return cut(p.profile_of_sales(v.transactions(spark, sf_dir), year, timed))


def transactional(own: DataFrame) -> DataFrame:
    """The profile with plateau_norm, the plateau over the longest of all."""
    longest = own.agg(F.max("plateau_score").alias("most"))
    return own.crossJoin(F.broadcast(longest)).withColumn("plateau_norm", F.col("plateau_score") / F.greatest("most", F.lit(1))).drop("most")  # one row


def places(own: DataFrame, prefixes: tuple[tuple[str, str], ...] = DOMAIN.provinces) -> DataFrame:
    """(outlet_id, distributor_id, province) of the primary distributor."""
    return own.select("outlet_id", "distributor_id").withColumn("province", province(F.col("distributor_id"), prefixes))


def temporal(primary: DataFrame, labels: DataFrame) -> DataFrame:
    """(outlet_id, label): the last seasonality label of its distributor for January, Moderate where there is none."""
    january = labels.where("month = 1")
    last = p.latest_label(january, "distributor_id", "year", "label")
    return primary.join(last, "distributor_id", "left").select("outlet_id", F.coalesce("label", F.lit("Moderate")).alias("season_label"))


def with_tiers(master: DataFrame, density: DataFrame) -> DataFrame:
    """Adds poi_tier (q1 to q4 by rank, ties by id) and urban (above the median)."""
    joined = master.join(density, "outlet_id", "left").withColumn("poi_density", F.coalesce("poi_density", F.lit(0)))
    ranked = running(joined, [F.col("poi_density").asc(), F.col("outlet_id").asc()], before=F.lit(1)).withColumn("rank", F.col("before") + 1).drop("before")
    n = ranked.agg(F.count("*").alias("n"))
    middle = ranked.crossJoin(F.broadcast(n)).where((F.col("rank") == F.floor((F.col("n") + 1) / 2)) | (F.col("rank") == F.floor((F.col("n") + 2) / 2)))  # one row
    whole = middle.agg(F.avg("poi_density").alias("median"), F.max("n").alias("n"))
    flagged = ranked.crossJoin(F.broadcast(whole))  # one row
    return flagged.withColumn("poi_tier", F.concat(F.lit("q"), tier(F.col("rank"), F.col("n")).cast("string"))).withColumn("urban", (F.col("poi_density") > F.col("median")).cast("int")).drop("rank", "n", "median")


def cluster_key(df: DataFrame) -> DataFrame:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in ("province", "outlet_type", "poi_tier")]
    return df.withColumn("cluster", F.concat_ws("|", *parts))


def peers(members: DataFrame) -> DataFrame:
    """(outlet_id, cluster, vol_mean, cluster_size, peer_rank, peer_p85, peer_p99, gap_to_p85) of members (outlet_id, cluster,
    vol_mean, volumes): the P85 and P99 are of the months of all in the cluster."""
    members = cut(members.select("outlet_id", "cluster", "vol_mean", "volumes"))
    by_month = quantiles(members.select("cluster", F.explode("volumes").alias("volume")), F.col("volume"), (0.85, 0.99), ["cluster"]).drop("n")
    ranked = pct_ranks(members.drop("volumes"), "vol_mean", "peer_rank", "cluster_size", ["cluster"])
    joined = ranked.join(by_month, "cluster", "left").withColumn("peer_p85", F.col("q")[0]).withColumn("peer_p99", F.col("q")[1]).drop("q")
    return joined.withColumn("gap_to_p85", F.greatest(F.col("peer_p85") - F.col("vol_mean"), F.lit(0.0)))


def physical(df: DataFrame) -> DataFrame:
    """Adds the physical ceiling of coolers: raw, at least 5 % above the best month, headroom, breach and use."""
    raw = F.when(F.col("coolers") > 0, F.col("coolers") * POTENTIAL.litres * POTENTIAL.turns).otherwise(POTENTIAL.no_cooler)
    own = df.withColumn("physical_raw", raw)
    return own.withColumns(
        {
            "physical_max": F.greatest("physical_raw", POTENTIAL.floor * F.col("vol_max")),
            "cooler_headroom": clip(F.col("physical_raw") - F.col("vol_max"), 0.0),
            "capacity_breached": (F.col("vol_max") > F.col("physical_raw")).cast("int"),
            "cooler_use": clip(F.col("vol_mean") / F.col("physical_raw"), None, 5.0),
        }
    )


def months_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel of the sales."""
    return p.monthly(v.transactions(spark, sf_dir))


def members(spark: SparkSession, sf_dir: str, own: DataFrame, rings: DataFrame | None = None) -> DataFrame:
    """(outlet_id, province, distributor_id, outlet_type, outlet_size, coolers, poi_density, poi_tier, urban, cluster) of the
    outlets of a profile. rings is `views.rings`, where the caller reads it as well."""
    master = v.outlets(spark, sf_dir)
    rings = v.rings(spark, sf_dir) if rings is None else rings
    density = rings.select("outlet_id", s.ring_density(rings).alias("poi_density"))
    placed = master.join(places(own), "outlet_id")
    return cluster_key(with_tiers(placed, density))


def feature_table(spark: SparkSession, sf_dir: str, year: int = 2000, own: DataFrame | None = None) -> DataFrame:
    """One row per active outlet with all features. own is `profile_of`, where the caller reads it as well."""
    own = transactional(profile_of(spark, sf_dir, year) if own is None else own.drop("months"))
    rings = stored(v.rings(spark, sf_dir))
    who = members(spark, sf_dir, own, rings)
    peer = peers(who.join(own.select("outlet_id", "vol_mean", "volumes"), "outlet_id")).drop("vol_mean", "cluster")
    density = s.densities(rings)
    near = s.rivals(v.coordinates(spark, sf_dir).where("lat != 0"), who)
    season = temporal(who.select("outlet_id", "distributor_id"), v.seasonality(spark, sf_dir).where(F.col("label").isin(*DOMAIN.labels)))
    shape = structural(who.select("outlet_id", "outlet_type", "outlet_size", "coolers"), own).drop("coolers")
    joined = reduce(lambda a, b: a.join(b, "outlet_id", "left"), [who, own.drop("distributor_id", "volumes", "hit_rate"), shape, peer, density, near, season])
    decayed = [c for c in density.columns if c != "outlet_id"]
    calendar = silver.working_days(v.holidays(spark, sf_dir), "2000-01-01", "2000-01-31")
    return physical(s.impute(joined, ["outlet_type", "province"], decayed, "poi_imputed")).crossJoin(F.broadcast(calendar))  # one row


FEATURES = (
    "vol_mean", "vol_median", "vol_max", "vol_std", "vol_cv", "price_avg", "sku_mean", "n_months", "recent_trend", "yoy_growth", "censoring_score", "plateau_norm", "coolers", "size_ordinal",
    "poi_density", "decayed_weighted", "gravity_weighted", "n_competitors", "market_share", "peer_rank", "cluster_size",
)
DENSITIES = tuple(f"decayed_{t}" for t in DECAY.types)
