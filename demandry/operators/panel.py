"""The outlet-month panel: roll-up of sales, and features of each outlet's own months.

Months are the active ones only, in the order of year * 12 + month. Sums are exact decimals. An outlet's months are as
many as there are months, so they are gathered in one array in one grouping, and the features read it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandry.functions.exprs import array_mode, array_quantile, array_sum, exact_avg, exact_parts, exact_sum, exact_total


MONTH = ("outlet_id", "y", "m", "gaps")


def _sold(tx: DataFrame, *by: str) -> DataFrame:
    """The sales of known outlets, dealt by some columns, with the parts of exact sums. A null year or month is a value of its
    own: `gaps` says which are null, so that tables of months join by MONTH."""
    gaps = F.col("year").isNull().cast("int") * 2 + F.col("month").isNull().cast("int")
    parts = [part.alias(f"{c}_{name}") for c in ("volume", "bill") for name, part in zip(("units", "many"), exact_parts(F.col(c)), strict=True)]
    own = tx.where(F.col("outlet_id").isNotNull()).select("outlet_id", F.coalesce("year", F.lit(0)).alias("y"), F.coalesce("month", F.lit(0)).alias("m"), gaps.alias("gaps"), "sku_id", "distributor_id", *parts)
    return own.repartition(*by)


def _totals(sold: DataFrame) -> DataFrame:
    """(MONTH..., volume, bill, n_tx, distributor_id): sums by distributor, and of these the months' own."""
    sums = [f"{c}_{name}" for c in ("volume", "bill") for name in ("units", "many")]
    shares = sold.groupBy(*MONTH, "distributor_id").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in sums])
    # The rank of a null distributor is after all others, however often it is there.
    often = F.struct((-F.when(F.col("distributor_id").isNotNull(), F.col("n")).otherwise(0)).alias("rank"), "distributor_id")
    total = lambda c: exact_total(F.sum(f"{c}_units"), F.sum(f"{c}_many")).alias(c)
    return shares.groupBy(*MONTH).agg(total("volume"), total("bill"), F.sum("n").alias("n_tx"), F.min(often)["distributor_id"].alias("distributor_id"))


def _skus(sold: DataFrame) -> DataFrame:
    return sold.groupBy(*MONTH).agg(F.count_distinct("sku_id").alias("n_skus"))


def _months(found: DataFrame) -> DataFrame:
    null_if = lambda c, bits: F.when(~F.col("gaps").isin(*bits), F.col(c))
    return found.select("outlet_id", null_if("y", (2, 3)).alias("year"), null_if("m", (1, 3)).alias("month"), "volume", "bill", "n_skus", "n_tx", "distributor_id")


def monthly(tx: DataFrame) -> DataFrame:
    """One row per outlet and month: volume, bill, n_skus, n_tx and the most frequent distributor (ties: the smallest)."""
    sold = _sold(tx, *MONTH)
    return _months(_totals(sold).join(_skus(sold).hint("merge"), list(MONTH)))


def profile_of_sales(tx: DataFrame, year: int = 0, timed: bool = False) -> DataFrame:
    """`profile` of `monthly`. Sales are dealt by outlet, so that months and profile are grouped where they lie; skus are
    counted apart and meet the outlets instead of the months."""
    sold = _sold(tx, "outlet_id")
    own = profile(_months(_totals(sold).withColumn("n_skus", F.lit(0))), year, timed=timed)
    skus = _skus(sold).groupBy("outlet_id").agg(F.sum("n_skus").alias("n"))
    return own.join(skus.hint("merge"), "outlet_id").withColumn("sku_mean", F.col("n") / F.col("n_months")).drop("n")


#: Columns of the profile that are statistics of the months, in the order of `stats`.
STATS = ("vol_mean", "vol_median", "vol_max", "vol_std", "vol_p75", "vol_p95", "vol_p99", "bill_mean", "vol_total", "n_tx", "sku_mean", "n_months", "vol_cv", "price_avg")


def profile(months: DataFrame, year: int = 0, share: float = 0.98, change: float = 0.05, timed: bool = False) -> DataFrame:
    """One row per outlet, of one grouping: distributor_id (the most frequent, ties to the smallest), volumes (in order of
    time), STATS, recent_trend, yoy_growth (of a year), censoring_score, plateau_score and hit_rate. Null volumes don't
    count but for the number of months. `timed` adds months, an array of (year, month, volume) in order of time."""
    v, dated = F.col("volume"), ["year", "month"] if timed else []
    mean = lambda y: exact_avg(F.when(F.col("year") == y, v))
    one = months.groupBy("outlet_id").agg(
        F.collect_list("distributor_id").alias("names"),
        F.sort_array(F.collect_list(F.struct((F.col("year") * 12 + F.col("month")).alias("time_idx"), "volume", *dated))).alias("timed"),
        exact_avg(v).alias("vol_mean"),
        F.max(v).alias("vol_max"),
        F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("vol_std"),
        exact_avg(F.col("bill")).alias("bill_mean"),
        exact_sum(v).alias("vol_total"),
        F.sum("n_tx").alias("n_tx"),
        F.avg("n_skus").alias("sku_mean"),
        F.count("*").alias("n_months"),
        mean(year).alias("now"),
        mean(year - 1).alias("then"),
    )
    one = one.withColumn("volumes", F.transform("timed", lambda m: m["volume"])).withColumn("ranked", F.array_sort(F.filter("volumes", lambda x: x.isNotNull())))
    one = one.withColumns({"vol_median": array_quantile("ranked", 0.5), "vol_p75": array_quantile("ranked", 0.75), "vol_p95": array_quantile("ranked", 0.95), "vol_p99": array_quantile("ranked", 0.99)})
    near = lambda limit: F.size(F.filter("ranked", lambda x: x >= share * limit)) / F.when(F.size("ranked") > 0, F.size("ranked"))
    return one.select(
        "outlet_id", array_mode(F.col("names")).alias("distributor_id"), "volumes", "vol_mean", "vol_median", "vol_max", "vol_std", "vol_p75", "vol_p95", "vol_p99", "bill_mean", "vol_total", "n_tx", "sku_mean", "n_months",
        (F.col("vol_std") / F.greatest("vol_mean", F.lit(1e-9))).alias("vol_cv"),
        (F.col("bill_mean") / F.greatest("vol_mean", F.lit(1e-9))).alias("price_avg"),
        _trend().alias("recent_trend"),
        F.coalesce(F.when(F.col("then") > 0, F.col("now") / F.col("then")), F.lit(1.0)).alias("yoy_growth"),
        near(F.col("vol_p95")).alias("censoring_score"),
        _plateau(change).alias("plateau_score"),
        near(F.col("vol_max")).alias("hit_rate"),
        *[F.transform("timed", lambda m: F.struct(m["year"].alias("year"), m["month"].alias("month"), m["volume"].alias("volume"))).alias("months")] * timed,
    )


def _trend() -> Column:
    """Mean of the last three active months over that of the three before; 1 with fewer than six or where those sold nothing.

    Both means are of three months, so the ratio of sums is the ratio of means.
    """
    n = F.size("volumes")
    last = F.when(n >= 6, F.slice("volumes", F.greatest(n - 5, F.lit(1)), F.lit(6)))
    near, far = array_sum(F.slice(last, 4, 3)), array_sum(F.slice(last, 1, 3))
    return F.coalesce(F.when((n >= 6) & (far > 0), near / far), F.lit(1.0))


def _plateau(change: float) -> Column:
    """Longest run of neighbouring active months that both reach the outlet's P75 and differ by less than `change`; counts
    pairs, 0 with fewer than three months."""
    n = F.size("volumes")
    pairs = F.arrays_zip(F.slice("volumes", F.lit(1), F.greatest(n - 1, F.lit(0))).alias("a"), F.slice("volumes", F.lit(2), F.greatest(n - 1, F.lit(0))).alias("b"))
    flat = lambda p: F.coalesce((p["a"] >= F.col("vol_p75")) & (p["b"] >= F.col("vol_p75")) & (F.abs(p["b"] - p["a"]) / F.greatest(p["a"], F.lit(1e-9)) < change), F.lit(False))

    def step(state: Column, p: Column) -> Column:
        run = F.when(flat(p), state["run"] + 1).otherwise(F.lit(0).cast("long"))
        return F.struct(run.alias("run"), F.greatest(state["best"], run).alias("best"))

    zero = F.struct(F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("best"))
    return F.when(n < 3, F.lit(0).cast("long")).otherwise(F.aggregate(pairs, zero, step, lambda s: s["best"]))


def primary_distributor(months: DataFrame) -> DataFrame:
    """(outlet_id, distributor_id): the most frequent over its months, ties to the smallest."""
    return months.groupBy("outlet_id").agg(F.mode("distributor_id", True).alias("distributor_id"))


def stats(months: DataFrame) -> DataFrame:
    """Aggregates of each outlet's months."""
    return profile(months).select("outlet_id", *STATS)


def recent_trend(months: DataFrame) -> DataFrame:
    return profile(months).select("outlet_id", "recent_trend")


def growth(months: DataFrame, year: int) -> DataFrame:
    """Mean month of a year over that of the year before; 1 where either is missing."""
    return profile(months, year).select("outlet_id", "yoy_growth")


def censoring_score(months: DataFrame, share: float = 0.98) -> DataFrame:
    """Share of an outlet's months near its own P95."""
    return profile(months, share=share).select("outlet_id", "censoring_score")


def plateau_score(months: DataFrame, change: float = 0.05) -> DataFrame:
    return profile(months, change=change).select("outlet_id", "plateau_score")


def latest_label(labels: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The value of the last row of each key."""
    return labels.groupBy(key).agg(F.max_by(value, order).alias(value))


def peak_hits(months: DataFrame, share: float = 0.98) -> DataFrame:
    """(outlet_id, distributor_id, hit_rate): the share of an outlet's months within 2 % of its best."""
    return profile(months, share=share).select("outlet_id", "hit_rate", "distributor_id")
