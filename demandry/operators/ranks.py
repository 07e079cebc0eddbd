"""Running sums, ranks and exact percentiles of a table or of its groups, without one task for all of a group.

Rows are dealt by ranges of (group, order): a large group spans several tasks, and small ones share one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandry.session import cut

#: Of a percentile's sketch: one over its error in ranks. Groups of fewer values than SMALL are ranked whole.
ACCURACY, SMALL = 10_000, 50_000
#: Groups that are joined to their rows by broadcast.
FEW = 100_000


def running(df: DataFrame, order: list[Column], by: Sequence[str] = (), **values: Column) -> DataFrame:
    """df with, for each named value, its sum over the rows of its group that come before in the given order.

    Rows are dealt by ranges of the group and the order, which the checkpoint fixes; sums within a range are windows of
    that range. Of the groups in a range only the first may have begun in an earlier one, so a table of at most one row
    for each range holds what to add. Rows that are equal in the order are taken in any turn and stay in one range, so
    order by something that tells them apart, or group them first. Null groups are a group.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = {f"value_{k}": v for k, v in values.items()}
    group = [F.col(c).asc() for c in by]
    dealt = cut(df.withColumns(named).repartitionByRange(ranges, *group, *order).withColumn("range", F.spark_partition_id()))
    whole = dealt.groupBy("range", *by).agg(*[F.sum(k).alias(f"all_{k}") for k in named])
    earlier = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    begun = whole.withColumns({f"off_{k}": F.sum(f"all_{k}").over(earlier) for k in named}).withColumn("n_before", F.count("*").over(earlier)).where("n_before > 0")
    offsets = begun.select(F.col("range").alias("of"), *[F.col(c).alias(f"of_{c}") for c in by], *[F.coalesce(f"off_{k}", F.lit(0)).alias(f"off_{k}") for k in named])
    within = Window.partitionBy("range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumns({f"own_{k}": F.coalesce(F.sum(k).over(within), F.lit(0)) for k in named})
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"of_{c}")), by, F.col("range") == F.col("of"))
    joined = summed.join(F.broadcast(offsets), same, "left")
    return joined.select(*df.columns, *[(F.coalesce(f"off_value_{k}", F.lit(0)) + F.col(f"own_value_{k}")).alias(k) for k in values])


def mean_ranks(df: DataFrame, column: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """df with the rank of a column's value in its group, equal values sharing the mean of their ranks.

    Values are counted before they are ranked, so that many equal ones are one row; nulls get no rank.
    """
    keys = {c: f"by_{c}" for c in by}
    counts = df.where(F.col(column).isNotNull()).groupBy(*[F.col(c).alias(k) for c, k in keys.items()], F.col(column).alias("value")).agg(F.count("*").alias("n"))
    ranked = running(counts, [F.col("value").asc()], list(keys.values()), before=F.col("n")).select(*keys.values(), "value", (F.col("before") + (F.col("n") + 1) / 2).alias(name))
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(keys[c])), by, F.col(column) == F.col("value"))
    return df.join(ranked, same, "left").drop("value", *keys.values())


def pct_ranks(df: DataFrame, column: str, name: str, size: str, by: Sequence[str]) -> DataFrame:
    """df with its group's rows (size) and the mean rank over the group's number of non-null values; null for null."""
    sizes = df.groupBy(*[F.col(c).alias(f"by_{c}") for c in by]).agg(F.count("*").alias(size), F.count(column).alias("known"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"by_{c}")) for c in by])
    joined = mean_ranks(df, column, name, by).join(sizes, same)
    return joined.withColumn(name, F.col(name) / F.col("known")).drop("known", *[f"by_{c}" for c in by])


def quantiles(df: DataFrame, value: Column, shares: Sequence[float], by: Sequence[str] = (), accuracy: int = ACCURACY, small: int = SMALL) -> DataFrame:
    """(by..., n, q) of each group: the number of values and the exact percentiles at the shares, linear between ranks.

    Selection in two passes, so that no buffer holds a group's values: a sketch of bounded size brackets each percentile,
    then the values below the bracket are counted and those in it, some part in `accuracy`, are ranked by ranges. Groups
    of fewer than `small` values are their own bracket. A bracket is four times as wide as the sketch's error; the counts
    tell if a rank is outside all the same, which is an error. Nulls don't count; a group without a value has n = 0 and
    null percentiles.
    """
    keys = [f"by_{k}" for k in range(len(by))]
    own = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], value.cast("double").alias("x"))
    own = own if keys else own.withColumn("by_0", F.lit(0))
    names = keys or ["by_0"]
    margin = 4 / accuracy
    edges = [F.array(*[F.lit(min(max(s + d, 0.0), 1.0)) for s in shares]) for d in (-margin, margin)]
    told = own.groupBy(*names).agg(F.count("x").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"), *[F.approx_percentile("x", e, F.lit(accuracy)).alias(c) for e, c in zip(edges, ("lows", "highs"), strict=True)])
    told = cut(told)
    found = _between(own, told, names, shares, small)
    same = reduce(lambda a, b: a & b, [told[k].eqNullSafe(found[k]) for k in names])
    whole = F.when(F.size("q") == len(shares), F.col("q")).otherwise(F.raise_error(F.lit("a rank lies outside of its bracket")))
    out = told.join(found, same, "left").select(*[told[k].alias(c) for k, c in zip(keys, by, strict=True)], "n", F.when(F.col("n") > 0, whole).alias("q"))
    return out if keys else out.select("n", "q")


def with_quantiles(df: DataFrame, value: Column, shares: Sequence[float], by: str, q: str, n: str | None = None, of: DataFrame | None = None) -> DataFrame:
    """df with the percentiles (q) and number of values (n) of each row's group, in df or in the table `of`; null where that has
    no such group.

    Groups are counted first: a few (up to FEW) are broadcast, so that the rows aren't shuffled by a column of few values;
    more are joined by a shuffle.
    """
    found = cut(quantiles(df if of is None else of, value, shares, [by]).select(F.col(by).alias("__group"), F.col("q").alias(q), *[F.col("n").alias(n)] if n else []))
    many = found.count()
    return df.join(F.broadcast(found) if many <= FEW else found, F.col(by).eqNullSafe(F.col("__group")), "left").drop("__group")


def _between(own: DataFrame, told: DataFrame, names: list[str], shares: Sequence[float], small: int) -> DataFrame:
    """(by..., q) of values and their groups' brackets; q misses the shares whose ranks aren't in their brackets."""
    whole = F.col("n") < small
    at = [F.lit(float(s)) * (F.col("n") - 1) for s in shares]
    wanted = F.array(*[F.struct(F.lit(k).alias("share"), p.alias("place"), F.when(whole, F.col("least")).otherwise(F.col("lows")[k]).alias("low"), F.when(whole, F.col("most")).otherwise(F.col("highs")[k]).alias("high")) for k, p in enumerate(at)])
    # Shares with the same bracket are ranked once.
    brackets = told.where("n > 0").select(*[F.col(k).alias(f"of_{k}") for k in names], F.explode(wanted).alias("w")).groupBy(*[f"of_{k}" for k in names], F.col("w.low").alias("low"), F.col("w.high").alias("high")).agg(F.collect_list(F.struct("w.share", "w.place")).alias("wanted"))
    lists = brackets.groupBy(*[f"of_{k}" for k in names]).agg(F.collect_list(F.struct("low", "high")).alias("brackets"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in names])
    hit = own.where("x is not null").join(lists, same).select(*names, "x", F.explode("brackets").alias("b")).where("x <= b.high")
    counts = hit.groupBy(*names, F.col("b.low").alias("low"), F.col("b.high").alias("high"), F.when(F.expr("x >= b.low"), F.col("x")).alias("value")).agg(F.count("*").alias("c"))
    ranked = running(counts, [F.col("value").asc_nulls_first()], [*names, "low", "high"], before=F.col("c")).where("value is not null")
    both = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"of_{c}" if c in names else f"b_{c}")), [*names, "low", "high"], F.lit(True))
    placed = ranked.join(brackets.withColumnsRenamed({"low": "b_low", "high": "b_high"}), both).select(*names, "value", "c", "before", F.explode("wanted").alias("w"))
    below, above = F.floor("w.place"), F.ceil("w.place")
    holds = lambda rank: (F.col("before") <= rank) & (rank < F.col("before") + F.col("c"))
    met = placed.where(holds(below) | holds(above)).groupBy(*names, F.col("w.share").alias("share"), F.col("w.place").alias("place")).agg(F.max(F.when(holds(below), F.col("value"))).alias("a"), F.max(F.when(holds(above), F.col("value"))).alias("b"))
    mixed = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((F.ceil("place") - F.col("place")) * F.col("a") + (F.col("place") - F.floor("place")) * F.col("b"))
    done = met.where("a is not null and b is not null").groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("share", mixed.alias("v")))).alias("q"))
    return done.select(*names, F.transform("q", lambda s: s["v"]).alias("q"))
