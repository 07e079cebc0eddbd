"""Cleaning of each raw table: rules in order, of which the first that fails names the reason."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandry.config import DOMAIN
from demandry.functions.exprs import null_token
from demandry.operators import quality as q
from demandry.operators.ranks import with_quantiles
from demandry.session import cut


def clean_transactions(tx: DataFrame, outlets: DataFrame, distributors: DataFrame) -> DataFrame:
    """tx with failure_reason and stage (1 to 10): nulls, year, month, volume, bill, outlet, distributor, duplicates, P99.9, price.

    Each stage sees the survivors of those before. Row-local stages are one expression; duplicates, P99.9 and price need
    windows over survivors: rejected rows sit in a partition of their own, cut off by a flag in the window's key.
    """
    known = outlets.select(F.col("outlet_id").alias("__o")).where("__o is not null").distinct()
    sellers = distributors.select(F.col("distributor_id").alias("__d")).where("__d is not null").distinct()
    joined = tx.join(known, tx.outlet_id == known["__o"], "left").join(sellers, tx.distributor_id == sellers["__d"], "left")
    local = [
        ("1 nulls", q.null_reason(tx, ["outlet_id", "distributor_id", "sku_id", "volume", "bill"])),
        ("2 year", q.allowed_reason("year", DOMAIN.years)),
        ("3 month", q.allowed_reason("month", DOMAIN.months)),
        ("4 volume", q.range_reason("volume", DOMAIN.positive)),
        ("5 bill", q.range_reason("bill", DOMAIN.positive)),
        ("6 outlet", F.when(F.col("__o").isNull(), "outlet_id not in outlets")),
        ("7 distributor", F.when(F.col("__d").isNull(), "distributor_id not in distributors")),
    ]
    why = F.coalesce(*[F.when(r.isNotNull(), F.struct(F.lit(s).alias("stage"), r.alias("reason"))) for s, r in local])
    own = joined.withColumn("__why", why).drop("__o", "__d")
    alive = F.col("__why").isNull()
    keys = ["outlet_id", "year", "month", "sku_id", "distributor_id"]
    at = F.row_number().over(Window.partitionBy(alive, *[F.when(alive, F.col(k)).alias(k) for k in keys], F.when(~alive, F.xxhash64("order_key", "line"))).orderBy("volume", "bill", "order_key", "line"))
    own = own.withColumn("__at", at).withColumn("__why", F.coalesce("__why", F.when(F.col("__at") > 1, _why("8 duplicate", "duplicate on [" + ", ".join(f"'{k}'" for k in keys) + "]")))).drop("__at")
    own = cut(own)  # three passes follow; scan, joins and window are not planned again for each
    # Percentiles of the survivors are selected by ranges and joined back, so that no sku is one task's.
    alive = "__why is null"
    own = with_quantiles(own, F.col("volume"), (0.999,), "sku_id", "__p", of=own.where(alive)).withColumn("__why", F.coalesce("__why", F.when(F.col("volume") > F.col("__p")[0], _why("9 outlier", "volume above P99.9 of its sku_id")))).drop("__p")
    price = F.when(F.col("volume") > 0, F.col("bill") / F.col("volume"))
    bounded = with_quantiles(own, price, (0.01, 0.99), "sku_id", "__b", "__n", of=own.where(alive))
    outside = F.col("__why").isNull() & (F.col("__n") > 1) & ~(price.between(F.col("__b")[0], F.col("__b")[1]))
    own = bounded.withColumn("__why", F.coalesce("__why", F.when(outside, _why("10 price", "price outside P1-P99 of its sku_id")))).drop("__b", "__n")
    return own.withColumn(q.REASON, F.col("__why.reason")).withColumn("stage", F.coalesce("__why.stage", F.lit("passed"))).drop("__why")


def _why(stage: str, reason: str):
    return F.struct(F.lit(stage).alias("stage"), F.lit(reason).alias("reason"))


def _steps(raw: DataFrame) -> DataFrame:
    title = F.initcap(F.trim("outlet_size"))
    kind = F.trim("outlet_type")
    fixed = reduce(lambda c, p: F.when(kind == p[0], p[1]).otherwise(c), DOMAIN.typos.items(), kind)
    number = null_token(F.col("coolers"), DOMAIN.null_tokens).try_cast("double")
    return raw.withColumns({"__title": title, "__size_bad": ~F.coalesce(title.isin(*DOMAIN.sizes), F.lit(False)), "__kind": F.coalesce(fixed, F.lit("Unknown")), "__number": number})


def clean_outlets(raw: DataFrame) -> DataFrame:
    """(outlet_id, outlet_type, outlet_size, coolers): faults replaced, null ids dropped, the first row of an id kept.

    Sizes are trimmed and title-cased, unknown ones become Medium; types lose their padding and typos, null is Unknown;
    coolers read as numbers, null as 1, negatives as 0, fractions cut.
    """
    own = _steps(raw).where("outlet_id is not null").withColumn("__at", F.row_number().over(Window.partitionBy("outlet_id").orderBy("row_no"))).where("__at = 1")
    coolers = F.when(F.col("__number").isNull(), 1).when(F.col("__number") < 0, 0).otherwise(F.floor("__number")).cast("long")
    return own.select("outlet_id", F.col("__kind").alias("outlet_type"), F.when(F.col("__size_bad"), "Medium").otherwise(F.col("__title")).alias("outlet_size"), coolers.alias("coolers"))


def conflicting_types(raw: DataFrame) -> DataFrame:
    """(outlet_id, n): ids whose rows name more than one type, after typos."""
    return _steps(raw).where("outlet_id is not null").groupBy("outlet_id").agg(F.count_distinct("__kind").alias("n")).where("n > 1")


def audit_outlets(raw: DataFrame) -> DataFrame:
    """(row_no, failure_reason): everything that clean_outlets replaced or dropped; a row may show several times."""
    own = _steps(raw).withColumn("__at", F.row_number().over(Window.partitionBy("outlet_id").orderBy("row_no")))
    found = F.array_compact(
        F.array(
            F.when(F.col("__size_bad"), "invalid outlet_size"),
            F.when(F.col("outlet_type").isNull(), "null outlet_type"),
            F.when(F.col("__number").isNull(), "null coolers"),
            F.when(F.col("__number") < 0, "negative coolers"),
            F.when(F.col("outlet_id").isNull(), "null outlet_id"),
            F.when(F.col("outlet_id").isNotNull() & (F.col("__at") > 1), "duplicate outlet_id"),
        )
    )
    return own.select("row_no", F.explode(found).alias(q.REASON))


def clean_coordinates(coords: DataFrame) -> DataFrame:
    """One row per outlet with in_box: points outside of the box are flagged and kept."""
    first = coords.where("outlet_id is not null").withColumn("__at", F.row_number().over(Window.partitionBy("outlet_id").orderBy("lat", "lon"))).where("__at = 1").drop("__at")
    return first.withColumn("in_box", q.geo_reason("lat", "lon", DOMAIN.box).isNull())


def clean_seasonality(labels: DataFrame, distributors: DataFrame) -> DataFrame:
    """labels with failure_reason: nulls, distributor, label, duplicate key, in this order."""
    sellers = distributors.select(F.col("distributor_id").alias("__d")).distinct()
    own = labels.join(sellers, labels.distributor_id == sellers["__d"], "left")
    own = q.tag(own, q.null_reason(labels, ["distributor_id", "year", "month", "label"]), F.when(F.col("__d").isNull(), "distributor_id not in distributors"), q.allowed_reason("label", DOMAIN.labels)).drop("__d")
    at = F.row_number().over(Window.partitionBy("distributor_id", "year", "month", F.col(q.REASON).isNull()).orderBy("row_no"))
    return own.withColumn("__at", at).withColumn(q.REASON, F.coalesce(q.REASON, F.when(F.col("__at") > 1, "duplicate on ['distributor_id', 'year', 'month']"))).drop("__at")


def clean_holidays(days: DataFrame) -> DataFrame:
    """days with date and failure_reason: nulls, unreadable dates, repeated (date, name, kind)."""
    own = q.tag(days, q.null_reason(days, ["day", "name", "kind"]), q.type_reason("day", "datetime")).withColumn("date", F.to_date(F.try_to_timestamp("day", F.lit("yyyy-MM-dd"))))
    at = F.row_number().over(Window.partitionBy("date", "name", "kind", F.col(q.REASON).isNull()).orderBy("row_no"))
    return own.withColumn("__at", at).withColumn(q.REASON, F.coalesce(q.REASON, F.when(F.col("__at") > 1, "duplicate on ['date', 'name', 'kind']"))).drop("__at")


def working_days(days: DataFrame, first: str, last: str) -> DataFrame:
    """One row for a month: holidays of each kind, distinct holiday dates, weekend days and working days (public holidays on weekdays are off)."""
    clean = q.split(clean_holidays(days))[0].where(F.col("date").between(first, last))
    calendar = days.sparkSession.sql(f"select explode(sequence(date'{first}', date'{last}', interval 1 day)) as date").withColumn("weekend", F.weekday("date") >= 5)
    public = clean.where("kind = 'Public'").select("date").distinct().withColumn("public", F.lit(True))
    counted = calendar.join(public, "date", "left").agg(F.count("*").alias("n_days"), F.count_if("weekend").alias("n_weekend"), F.count_if(F.coalesce("public", F.lit(False)) & ~F.col("weekend")).alias("n_off"))
    kinds = [F.count_if(F.col("kind") == k).alias(f"n_{k.lower().replace(' ', '_')}") for k in ("Public", "Bank", "Mercantile", "Poya Day")]
    per = clean.agg(*kinds, F.count_distinct("date").alias("n_dates"))
    return counted.crossJoin(F.broadcast(per)).select(*[c for c in per.columns], "n_weekend", (F.col("n_days") - F.col("n_weekend") - F.col("n_off")).alias("n_working"))  # one row each
