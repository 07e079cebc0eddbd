"""Column expressions that Spark lacks by that name, or has with other null semantics."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """x within bounds; null stays null (greatest and least alone would skip it)."""
    y = x if low is None else F.greatest(x, F.lit(low))
    y = y if high is None else F.least(y, F.lit(high))
    return F.when(x.isNotNull(), y)


def greatest_or_null(*xs: Column) -> Column:
    """The greatest, or null if any is null."""
    return F.when(reduce(lambda a, b: a & b, [x.isNotNull() for x in xs]), F.greatest(*xs))


def least_or_null(*xs: Column) -> Column:
    return F.when(reduce(lambda a, b: a & b, [x.isNotNull() for x in xs]), F.least(*xs))


def null_token(x: Column, tokens: tuple[str, ...]) -> Column:
    """A string read from CSV, with the tokens that mean nothing made null."""
    return F.when(~F.trim(x).isin(*tokens), x)


#: Numbers of fewer units than SMALL are summed as they are, of others what they have beyond multiples of MANY: 64 bits
#: hold the sums of 10^8 rows.
SMALL, MANY = 1 << 36, 1_000_000_000


def exact_parts(x: Column, scale: int = 2) -> tuple[Column, Column]:
    """(units, many) of a number to be summed exactly, whole numbers both: it is rounded to units of 10^-scale, of which it has
    units + MANY * many. Small numbers of units (many is null then) don't become decimals."""
    unit = 10.0**scale
    near = F.rint(x * unit)
    small = (near / unit == x) & (F.abs(near) < SMALL)
    every = (x.cast(f"decimal(18,{scale})") * F.lit(10**scale)).cast("long")
    return F.when(small, near.cast("long")).otherwise(every % MANY), F.when(~small, F.call_function("div", every, F.lit(MANY)))


def exact_total(units: Column, many: Column, scale: int = 2) -> Column:
    """The number that the sums of both parts make up; null if both are."""
    whole = units.cast("decimal(19,0)") + F.coalesce(many, F.lit(0)).cast("decimal(19,0)") * F.lit(MANY)
    return F.when(many.isNull() & (F.abs(units) < 1 << 53), units.cast("double") / 10.0**scale).otherwise((whole * F.lit(Decimal(1).scaleb(-scale))).cast("double"))


def exact_sum(x: Column, scale: int = 2) -> Column:
    """A sum of money or litres that doesn't depend on the order of its rows."""
    units, many = exact_parts(x, scale)
    return exact_total(F.sum(units), F.sum(many), scale)


def exact_avg(x: Column, scale: int = 2) -> Column:
    return exact_sum(x, scale) / F.count(x)


def array_sum(xs: Column, scale: int = 2) -> Column:
    """The exact sum of an array's numbers; nulls don't count, null of none."""
    kind = f"decimal(18,{scale})"
    known = F.filter(xs, lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0).cast(kind), lambda a, x: (a + x.cast(kind)).cast(kind)).cast("double"))


def array_quantile(ranked: str, share: float) -> Column:
    """The percentile of a sorted array without nulls, linear between ranks; null of none."""
    n = F.size(ranked)
    place = F.lit(share) * (n - 1)
    low, high = F.floor(place).cast("int"), F.ceil(place).cast("int")
    a, b = F.try_element_at(F.col(ranked), low + 1), F.try_element_at(F.col(ranked), high + 1)
    return F.when(n > 0, F.when(low == high, a).otherwise((high - place) * a + (place - low) * b))


def array_mode(xs: Column) -> Column:
    """The most frequent value of an array without nulls, ties to the smallest; null of none."""
    counted = F.transform(F.array_distinct(xs), lambda d: F.struct((-F.size(F.filter(xs, lambda x: x == d))).alias("rank"), d.alias("value")))
    return F.array_min(counted)["value"]


def chord(lat1: Column, lon1: Column, lat2: Column, lon2: Column, cosine1: Column, cosine2: Column) -> Column:
    """The square of half the chord between two points in degrees, on a sphere of radius 1; the cosines are of the latitudes."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    return F.pow(F.sin(dlat / 2), 2) + cosine1 * cosine2 * F.pow(F.sin(dlon / 2), 2)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6_371_000.0) -> Column:
    """Metres between two points in degrees."""
    a = chord(lat1, lon1, lat2, lon2, F.cos(F.radians(lat1)), F.cos(F.radians(lat2)))
    return 2 * radius * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def pct_rank(value: Column, *by: Column) -> Column:
    """Rank over the number of non-null values, ties at their mean rank; null for null."""
    group = Window.partitionBy(*by)
    rank = F.rank().over(group.orderBy(value.asc_nulls_last()))
    ties = F.count(value).over(Window.partitionBy(*by, value))
    return F.when(value.isNotNull(), (rank + (ties - 1) / 2) / F.count(value).over(group))


def tier(rank: Column, n: Column, parts: int = 4) -> Column:
    """The quantile bin (1 to parts) of a rank among n: edges 1 + (n-1)k/parts, closed on the right."""
    step = (parts * (rank - 1) + n - 2).cast("long")
    return F.when(n <= 1, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(step / (n - 1)).cast("int")))


def ceil_to(x: Column, digits: int = 2) -> Column:
    return F.ceil(x * 10**digits).cast("double") / 10**digits


def province(distributor: Column, prefixes: tuple[tuple[str, str], ...], unknown: str = "Unknown") -> Column:
    """The province of the first prefix that a distributor id begins with (followed by an underscore)."""
    found = F.lit(unknown)
    for prefix, name in reversed(prefixes):
        found = F.when(distributor.startswith(prefix + "_"), name).otherwise(found)
    return found


def one_hot(x: Column, values: tuple[str, ...], prefix: str) -> list[Column]:
    """0/1 columns for a fixed vocabulary; all 0 for null or another value."""
    return [F.coalesce((x == v).cast("int"), F.lit(0)).alias(f"{prefix}_{v}".replace(" ", "_")) for v in values]


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(v) for pair in pairs.items() for v in pair])


def matches(x: Column, pattern: str) -> Column:
    """Case-insensitive regular-expression search; null is no match."""
    return F.coalesce(x.rlike("(?i)" + pattern), F.lit(False))
