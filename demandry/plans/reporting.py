"""Questions to the finished tables: headline numbers, segments, lists, histograms, effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandry.config import POTENTIAL
from demandry.functions.exprs import exact_avg, matches
from demandry.operators.ranks import quantiles
from demandry.session import cut

#: Groups of rejection reasons, the first that a reason's text contains.
REASONS = (("null", "Missing values"), ("duplicate", "Duplicates"), ("p99.9", "Outliers"), ("above", "Outliers"), ("price", "Price checks"), ("out of range", "Bad quantities"), ("not in", "Unknown references"), ("box", "Bad coordinates"))


def headline(diagnostic: DataFrame) -> DataFrame:
    """One row: count, mean, median, extremes, P95, P99, totals, multiple, shares of the winners."""
    x, own = F.col("potential"), cut(diagnostic.select("potential", "vol_mean", "winner"))
    ranks = quantiles(own, x, (0.5, 0.95, 0.99)).select(*[F.round(F.col("q")[k], 4).alias(c) for k, c in enumerate(("median", "p95", "p99"))])
    one = own.agg(
        F.count("*").alias("outlets"), F.round(exact_avg(x, 4), 4).alias("mean"), F.round(F.min(x), 4).alias("least"), F.round(F.max(x), 4).alias("most"), F.round(F.sum(x), 2).alias("total"), F.round(F.sum("vol_mean"), 2).alias("actual"),
        F.round(F.sum(x) / F.sum("vol_mean"), 4).alias("multiple"), F.round(F.avg((F.col("winner") == "floor").cast("double")), 6).alias("floor_share"),
    )
    return one.join(F.broadcast(ranks), F.lit(True), "left").select("outlets", "mean", "median", "least", "most", "p95", "p99", *one.columns[4:])  # one row each


def serving(predictions: DataFrame, diagnostic: DataFrame, extra: DataFrame, coordinates: DataFrame) -> DataFrame:
    """One row for each prediction, with what explains it, where it is, constraint_type and uplift_pct over the best month;
    what a prediction has no row for is null. Columns that diagnostic has already aren't taken from extra."""
    more = extra.select("outlet_id", *[c for c in extra.columns if c not in diagnostic.columns])
    joined = predictions.join(diagnostic.drop("constraint_type"), "outlet_id", "left").join(more, "outlet_id", "left").join(coordinates.select("outlet_id", "lat", "lon"), "outlet_id", "left")
    kind = F.when(F.col("censoring_score") > POTENTIAL.supply_bound, "supply").when(F.col("censoring_score").isNotNull(), "demand")
    return joined.withColumn("constraint_type", kind).withColumn("uplift_pct", (F.col("max_monthly_litres") / F.greatest("vol_max", F.lit(1.0)) - 1) * 100)


def budget_view(detail: DataFrame | None, bare: DataFrame) -> DataFrame:
    """Funded outlets (spend above 1), the dearest first: of the detailed table, or of the bare one where there is none."""
    own = detail if detail is not None else bare
    return own.where("spend > 1").orderBy(F.desc("spend"), "outlet_id")


def geo_points(predictions: DataFrame, coordinates: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """(outlet_id, lat, lon, log_litres) of the outlets within the box: log10 of the prediction, 1 at least."""
    south, north, west, east = box
    placed = coordinates.where(F.col("lat").between(south, north) & F.col("lon").between(west, east)).select("outlet_id", "lat", "lon")
    return predictions.join(placed, "outlet_id").select("outlet_id", "lat", "lon", F.log10(F.greatest("max_monthly_litres", F.lit(1.0))).alias("log_litres"))


def driver_example(diagnostic: DataFrame, drivers: DataFrame) -> DataFrame:
    """(outlet_id, feature, value): the drivers, least first, of the largest potential among the outlets that supply holds
    back (of any, if there is none). drivers has outlet_id, ups and downs."""
    own = diagnostic.join(drivers.select("outlet_id", "ups", "downs"), "outlet_id").withColumn("held", (F.col("censoring_score") > POTENTIAL.supply_bound).cast("int"))
    one = own.orderBy(F.desc_nulls_last("held"), F.desc("potential"), "outlet_id").limit(1)
    return one.select("outlet_id", F.explode(F.concat("ups", "downs")).alias("d")).select("outlet_id", "d.feature", "d.value").orderBy("value", "feature")


def outlet_trends(months: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """(outlet_id, at, volume, peak): the months of n outlets, drawn by a hash, on a time axis in years, with their best."""
    months = cut(months.select("outlet_id", "year", "month", "volume"))
    peaks = months.groupBy("outlet_id").agg(F.max("volume").alias("peak"))
    drawn = seeded_sample(peaks, "outlet_id", n, seed)
    return months.join(F.broadcast(drawn), "outlet_id").select("outlet_id", (F.col("year") + (F.col("month") - 1) / 12).alias("at"), "volume", "peak")  # n rows


def panel_counts(profile: DataFrame) -> DataFrame:
    """One row of the panel's headline numbers: outlets, outlet-months, median active months, median month, and outlets
    with more than three tenths of their months near the best."""
    own = cut(profile.select("n_months", "volumes", "hit_rate"))
    active = quantiles(own, F.col("n_months"), (0.5,)).select(F.col("q")[0].alias("median_months"))
    litres = quantiles(own.select(F.explode("volumes").alias("v")), F.col("v"), (0.5,)).select(F.col("q")[0].alias("median_volume"))
    one = own.agg(F.count("*").alias("outlets"), F.sum("n_months").alias("outlet_months"), F.count_if(F.col("hit_rate") > 0.3).alias("near_best"))
    return one.crossJoin(F.broadcast(active)).crossJoin(F.broadcast(litres))  # one row each


def segments(diagnostic: DataFrame) -> DataFrame:
    """(segment, value, outlets, mean) by size, type, province and town."""
    kinds = F.array(*[F.struct(F.lit(c).alias("segment"), F.col(c).cast("string").alias("value")) for c in ("outlet_size", "outlet_type", "province", "urban")])
    every = diagnostic.select("potential", F.explode(kinds).alias("kind")).select("kind.*", "potential")
    return every.groupBy("segment", "value").agg(F.count("*").alias("outlets"), F.round(exact_avg(F.col("potential"), 4), 4).alias("mean"))


def kpis(diagnostic: DataFrame) -> DataFrame:
    return diagnostic.agg(F.count("*").alias("outlets"), F.round(exact_avg(F.col("potential"), 4), 4).alias("mean"), F.round(F.sum("potential"), 2).alias("total"), F.round(100 * F.avg((F.col("constraint_type") == "supply").cast("double")), 4).alias("supply_pct"))


def browse(diagnostic: DataFrame, provinces: list[str] | None = None, search: str | None = None, k: int = 50) -> DataFrame:
    """The k largest potentials among the filtered outlets; search is a regular expression over id, type and distributor."""
    own = diagnostic
    if provinces:
        own = own.where(F.col("province").isin(*provinces))
    if search:
        own = own.where(matches(F.col("outlet_id").cast("string"), search) | matches(F.col("outlet_type"), search) | matches(F.col("distributor_id"), search))
    return own.select("outlet_id", "province", "outlet_type", "distributor_id", F.round("potential", 6).alias("potential"), F.round(100 * (F.col("potential") / F.col("vol_mean") - 1), 4).alias("uplift_pct")).orderBy(F.desc("potential"), "outlet_id").limit(k)


def facets(diagnostic: DataFrame, provinces: list[str]) -> DataFrame:
    """(facet, value): the provinces, and the distributors of the chosen ones."""
    return diagnostic.select(F.lit("province").alias("facet"), F.col("province").alias("value")).unionByName(diagnostic.where(F.col("province").isin(*provinces)).select(F.lit("distributor").alias("facet"), F.col("distributor_id").alias("value"))).distinct()


def drill_down(diagnostic: DataFrame, outlet_id: int | None = None) -> DataFrame:
    """One outlet's row: the one asked for, else the one of the largest potential."""
    if outlet_id is not None:
        return diagnostic.where(F.col("outlet_id") == outlet_id)
    return diagnostic.orderBy(F.desc("potential"), "outlet_id").limit(1)


def bucket_of(reason: Column) -> Column:
    found = F.lit("Other")
    for part, name in reversed(REASONS):
        found = F.when(F.lower(reason).contains(part), name).otherwise(found)
    return found


def reject_buckets(rejected: DataFrame, k: int = 12) -> DataFrame:
    return rejected.groupBy(bucket_of(F.col("failure_reason")).alias("bucket")).agg(F.count("*").alias("n_rows")).orderBy(F.desc("n_rows"), "bucket").limit(k)


def histogram(df: DataFrame, column: str, width: float) -> DataFrame:
    """(bin, n) of bins of one width; the bin's lower edge."""
    return df.where(F.col(column).isNotNull()).groupBy((F.floor(F.col(column) / width) * width).cast("double").alias("bin")).agg(F.count("*").alias("n"))


def box_stats(df: DataFrame, by: str, column: str) -> DataFrame:
    """Quartiles and whiskers (1.5 quartile ranges, within the data) of each group."""
    df = cut(df.select(by, column))
    q = quantiles(df, F.col(column), (0.25, 0.5, 0.75), [by])
    bounds = q.select(F.col(by).alias("__by"), F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    joined = df.join(bounds, F.col(by).eqNullSafe(F.col("__by")))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.when(F.col(column).between(F.col("q1") - reach, F.col("q3") + reach), F.col(column))
    return joined.groupBy(by).agg(F.round(F.first("q1"), 6).alias("q1"), F.round(F.first("median"), 6).alias("median"), F.round(F.first("q3"), 6).alias("q3"), F.round(F.min(inside), 6).alias("low"), F.round(F.max(inside), 6).alias("high"))


def seasonality_effect(months: DataFrame, labels: DataFrame, base: str = "Moderate") -> DataFrame:
    """Mean month of each label, and its distance in percent from the base label's."""
    per = months.join(labels.select("distributor_id", "year", "month", "label"), ["distributor_id", "year", "month"]).groupBy("label").agg(F.count("*").alias("n"), exact_avg(F.col("volume")).alias("mean"))
    against = F.max(F.when(F.col("label") == base, F.col("mean"))).over(Window.partitionBy())  # over a row for each label
    return per.select("label", "n", F.round("mean", 6).alias("mean"), F.round(100 * (F.col("mean") / against - 1), 6).alias("vs_base_pct"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def seeded_sample(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by the hash of their id: the same on every run and partitioning."""
    return df.orderBy(F.md5(F.concat_ws("-", F.col(id_col).cast("string"), F.lit(str(seed)))), id_col).limit(n)
