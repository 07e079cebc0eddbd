"""Explanations: top drivers, evidence, text from a template, and the check that its numbers are grounded."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandry.session import cut

#: How features are called in texts.
LABELS = {
    "vol_mean": "average monthly volume", "vol_max": "best month", "recent_trend": "recent trend", "yoy_growth": "growth over the last year", "censoring_score": "months at the ceiling",
    "plateau_score": "length of the plateau", "market_share": "share of the neighbourhood", "coolers": "coolers", "decayed_weighted": "points of interest nearby",
}


def label_for(name: str) -> str:
    """The label of a feature; unknown names are read from their parts."""
    for prefix, said in (("decayed_", "nearness of "), ("gravity_", "pull of "), ("month_", "season ")):
        if name not in LABELS and name.startswith(prefix):
            return said + name[len(prefix) :].replace("_", " ")
    return LABELS.get(name, name.replace("_", " "))


def top_drivers(df: DataFrame, features: Sequence[str], k: int = 3, least: float = 1e-6, of: dict[str, Column] | None = None) -> list[Column]:
    """(ups, downs): the k largest positive and negative contributions of a row as arrays of (feature, value).

    A contribution is the column of its feature, or what `of` has for it. month_* contributions count as one. Values are rounded to four digits; equal ones are in the order of their names.
    """
    months = [f for f in features if f.startswith("month_")]
    rest = [f for f in features if f not in months]
    pairs = [F.struct(F.lit(f).alias("feature"), (of or {}).get(f, F.col(f)).alias("value")) for f in rest]
    if months:
        pairs.append(F.struct(F.lit("month").alias("feature"), sum((F.col(m) for m in months), F.lit(0.0)).alias("value")))
    every = F.array(*pairs)
    order = lambda sign: lambda a, b: F.when(a["value"] * sign > b["value"] * sign, -1).when(a["value"] * sign < b["value"] * sign, 1).when(a["feature"] < b["feature"], -1).when(a["feature"] > b["feature"], 1).otherwise(0)
    cut = lambda arr: F.transform(F.slice(arr, 1, k), lambda p: F.struct(p["feature"].alias("feature"), F.round(p["value"], 4).alias("value")))
    ups = cut(F.array_sort(F.filter(every, lambda p: p["value"] > least), order(1)))
    downs = cut(F.array_sort(F.filter(every, lambda p: p["value"] < -least), order(-1)))
    return [ups.alias("ups"), downs.alias("downs")]


def evidence(*columns: tuple[str, Column]) -> Column:
    """A struct of named facts."""
    return F.struct(*[c.alias(name) for name, c in columns])


#: The facts of a packet in their order, with the digits that each is rounded to (none: taken as it is).
PACKET = (
    ("outlet_id", None), ("province", None), ("distributor_id", None), ("outlet_type", None), ("outlet_size", None), ("potential", 0), ("vol_max", 0), ("vol_mean", 0), ("uplift_vs_peak_pct", 0),
    ("coolers", 0), ("physical_max", 0), ("decayed_weighted", 3), ("n_competitors", 0), ("market_share", 2), ("peer_rank_pct", 0), ("months_at_ceiling_pct", 0), ("constraint_type", None), ("season", 2),
)


def facts(df: DataFrame) -> DataFrame:
    """The facts of each outlet's packet (PACKET), halves rounded to even, null where a fact isn't known.

    df has the diagnostic's columns and decayed_weighted, n_competitors, market_share and peer_rank.
    """
    peak = F.greatest(F.coalesce("vol_max", F.lit(1.0)), F.lit(1.0))
    own = df.withColumns(
        {
            "uplift_vs_peak_pct": (F.col("potential") / peak - 1) * 100, "peer_rank_pct": F.col("peer_rank") * 100, "months_at_ceiling_pct": F.col("censoring_score") * 100,
            **{c: F.coalesce(F.col(c), F.lit("Unknown")) for c in ("province", "distributor_id", "outlet_type", "outlet_size")},
        }
    )
    return own.select(*[F.col(c) if digits is None else F.bround(F.col(c).cast("double"), digits).alias(c) for c, digits in PACKET])


def template_text(floor: Column, potential: Column, mean: Column, trend: Column, supply: Column, coolers: Column) -> Column:
    """Four labelled lines from whole numbers of the evidence."""
    whole = lambda c: F.round(c, 0).cast("long").cast("string")
    why = F.when(supply, "sales press against what can be supplied").otherwise("demand sets the pace")
    act = F.when(supply & (coolers <= 1), "add a cooler").when(supply, "raise the drop size").otherwise("run a promotion")
    return F.concat(
        F.lit("Potential: "), whole(potential), F.lit(" L a month, from "), whole(mean), F.lit(" L on average.\nFloor: "), whole(floor),
        F.lit(" L.\nReason: "), why, F.lit(", with a trend of "), F.round(trend * 100, 0).cast("long").cast("string"), F.lit(" %.\nAction: "), act, F.lit("."),
    )


def ungrounded(text: Column, allowed: Column, slack: int = 2) -> Column:
    """Numbers of a text (not next to a letter, above 1), rounded, that aren't within the slack of an allowed one."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9.])(\d+(?:\.\d+)?)(?![A-Za-z0-9])"), F.lit(1)), lambda x: F.round(x.cast("double")).cast("long"))
    return F.array_distinct(F.filter(found, lambda n: (n > 1) & ~F.exists(allowed, lambda a: F.abs(a - n) <= slack)))


def allowed_numbers(*facts: Column, drivers: Column | None = None) -> Column:
    """The whole numbers that a text may give: those of the packet's facts, and of its drivers' values."""
    own = F.array(*[F.abs(F.round(f.cast("double"))).cast("long") for f in facts])
    if drivers is not None:
        own = F.concat(own, F.transform(drivers, lambda d: F.abs(F.round(d["value"])).cast("long")))
    return F.filter(own, lambda x: x.isNotNull())


def live_sample(df: DataFrame, score: str, n: int, key: str = "outlet_id", seed: int = 42) -> DataFrame:
    """n rows to be explained live: a third of them the largest by score, the others drawn by a seeded hash of the key."""
    df = cut(df)  # both parts read it
    top = df.orderBy(F.desc(score), key).limit(n // 3)
    mixed = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))
    rest = df.join(F.broadcast(top.select(key)), key, "left_anti").orderBy(mixed, key).limit(n - n // 3)  # n // 3 rows
    return top.unionByName(rest)


def prompt(evidence_column: Column) -> Column:
    return F.concat(F.lit("Explain the potential in four lines, with no number that is not in this record: "), F.to_json(evidence_column))


def explain(df: DataFrame, text: Column, provider: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """df with explanation and source. A provider (DataFrame in, DataFrame with live_text out) may answer first; where it
    gives nothing the template stands."""
    if provider is None:
        return df.withColumn("explanation", text).withColumn("source", F.lit("template"))
    live = provider(df).withColumn("explanation", F.coalesce("live_text", text))
    return live.withColumn("source", F.when(F.col("live_text").isNotNull(), "live").otherwise("template")).drop("live_text")
