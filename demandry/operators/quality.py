"""Data-quality rules over one tagged plan: a nullable reason, then two filters.

Rules are columns, so neighbouring ones fuse into one pass; those that need a group's rows (first of a key, percentiles)
are windows or small joins. Null keys equal each other, and an id column or the full row gives `first` a total order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandry.operators.ranks import with_quantiles

REASON = "failure_reason"


def split(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(passed, rejected) of a frame with a failure_reason."""
    return tagged.where(F.col(REASON).isNull()).drop(REASON), tagged.where(F.col(REASON).isNotNull())


def tag(df: DataFrame, *reasons: Column) -> DataFrame:
    """df with the first reason that applies to each row."""
    return df.withColumn(REASON, F.coalesce(*reasons, F.lit(None).cast("string")))


def duplicate_reason(keys: Sequence[str], order: Sequence[str]) -> Column:
    """Every row of a key but the first in the given order."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return F.when(at > 1, "duplicate on [" + ", ".join(f"'{k}'" for k in keys) + "]")


def null_reason(df: DataFrame, required: Sequence[str]) -> Column:
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"columns not in the table: {missing}")
    names = F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in required]))
    return F.when(F.size(names) > 0, F.concat(F.lit("null in: "), F.array_join(names, ",")))


def reference(df: DataFrame, column: str, known: DataFrame, known_column: str, label: str) -> DataFrame:
    """df tagged where the value isn't in the reference table; a null value fails, null references don't count."""
    keys = known.where(F.col(known_column).isNotNull()).select(F.col(known_column).alias("__known")).distinct()
    return df.join(keys, F.col(column) == F.col("__known"), "left").withColumn(REASON, F.when(F.col("__known").isNull(), f"{column} not in {label}")).drop("__known")


def range_reason(column: str, low: float | None = None, high: float | None = None) -> Column:
    """Outside of inclusive bounds, null or no number."""
    x = F.col(column).try_cast("double")
    inside = reduce(lambda a, b: a & b, [c for c in (x >= low if low is not None else None, x <= high if high is not None else None) if c is not None], x.isNotNull())
    return F.when(~F.coalesce(inside, F.lit(False)), f"{column} out of range [{low}, {high}]")


def allowed_reason(column: str, values: Sequence) -> Column:
    shown = str(sorted(values)) if len(values) <= 20 else "allowed set"
    return F.when(~F.coalesce(F.col(column).isin(*values), F.lit(False)), f"{column} not in {shown}")


def regex_reason(column: str, pattern: str) -> Column:
    """No full match; null reads as nan."""
    return F.when(~F.coalesce(F.col(column).cast("string"), F.lit("nan")).rlike(f"^(?:{pattern})$"), f"{column} does not match {pattern}")


def type_reason(column: str, kind: str) -> Column:
    """Not readable as int (a whole number), float or datetime."""
    x = F.col(column).cast("string")
    if kind == "datetime":
        good = F.coalesce(F.try_to_timestamp(x, F.lit("yyyy-MM-dd")), F.try_to_timestamp(x, F.lit("yyyy-MM-dd HH:mm:ss"))).isNotNull()
    else:
        number = x.try_cast("double")
        good = number.isNotNull() & (number == F.floor(number) if kind == "int" else F.lit(True))
    return F.when(~F.coalesce(good, F.lit(False)), f"{column} is not {kind}")


def geo_reason(lat: str, lon: str, box: tuple[float, float, float, float]) -> Column:
    """Outside of the box (south, north, west, east), bounds included; null fails."""
    y, x = F.col(lat).try_cast("double"), F.col(lon).try_cast("double")
    return F.when(~F.coalesce(y.between(box[0], box[1]) & x.between(box[2], box[3]), F.lit(False)), "outside the bounding box")


def price_check(df: DataFrame, volume: str, bill: str, group: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """df tagged where bill / volume is outside of its group's percentiles; groups of one price pass, a null price fails."""
    price = F.when(F.col(volume) > 0, F.col(bill) / F.col(volume))
    outside = (F.col("__n") > 1) & ~F.coalesce(price.between(F.col("__p")[0], F.col("__p")[1]), F.lit(False))
    joined = with_quantiles(df, price, (low, high), group, "__p", "__n")
    return joined.withColumn(REASON, F.when(outside, f"price outside P{round(low * 100)}-P{round(high * 100)} of its {group}")).drop("__p", "__n")


def upper_tail(df: DataFrame, value: str, group: str, share: float = 0.999) -> DataFrame:
    """df tagged where a value is above its group's percentile (linear between ranks)."""
    return with_quantiles(df, F.col(value), (share,), group, "__p").withColumn(REASON, F.when(F.col(value) > F.col("__p")[0], f"{value} above P{share * 100:g} of its {group}")).drop("__p")


def ring_reason(types: Sequence[str], rings: Sequence[int]) -> Column:
    """Counts that are negative or shrink as the ring widens; names the first such type. Columns are <type>_<ring>."""
    reasons = []
    for kind in types:
        cols = [F.coalesce(F.col(f"{kind}_{r}"), F.lit(0)) for r in rings]
        bad = reduce(lambda a, b: a | b, [c < 0 for c in cols] + [a > b for a, b in zip(cols, cols[1:], strict=False)])
        reasons.append(F.when(bad, f"rings of {kind} not monotone"))
    return F.coalesce(*reasons)


def collect_rejects(stages: dict[str, DataFrame]) -> DataFrame:
    """The rejected rows of several stages under one schema, each with its stage."""
    tagged = [df.withColumn("stage", F.lit(name)) for name, df in stages.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def summary(dataset: str, metrics: dict[str, Column], df: DataFrame) -> DataFrame:
    """(dataset, metric, value) of aggregates, in one pass."""
    one = df.agg(*[c.cast("long").alias(m) for m, c in metrics.items()])
    return one.unpivot([], list(metrics), "metric", "value").select(F.lit(dataset).alias("dataset"), "metric", "value")


def null_census(df: DataFrame) -> DataFrame:
    """(column_name, nulls) for every column, in one pass."""
    one = df.agg(*[F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(c) for c in df.columns])
    return one.unpivot([], df.columns, "column_name", "nulls")


def conform(df: DataFrame, expected: Sequence[str]) -> dict[str, list[str]]:
    """Columns that are missing or unexpected; a report, not a failure."""
    return {"missing": [c for c in expected if c not in df.columns], "unexpected": [c for c in df.columns if c not in expected]}


def reconcile(df: DataFrame, template: Sequence[str], fill: float = 0.0) -> DataFrame:
    """df with exactly the template's columns in its order; absent ones are filled."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(fill).alias(c) for c in template])


def numeric_only(df: DataFrame, drop: Sequence[str] = ()) -> DataFrame:
    """df without the named columns and those that aren't numbers."""
    from pyspark.sql.types import NumericType

    return df.select(*[f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in drop])
