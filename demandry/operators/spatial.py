"""Points on a map: joins within a radius on a grid, shell decay of points of interest, imputation by cluster."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandry.config import DECAY
from demandry.functions.exprs import chord, clip, haversine
from demandry.operators.ranks import quantiles
from demandry.session import cut


#: Points of a cell that one task compares with as many around it.
DENSE = 2000
#: Parts for each partition of a join that crowded cells are dealt to, the most points of a part, and of a bundle of a place.
PARTS, MOST, BUNDLE = 16, 1_000_000, 1000


def _band_cells(lat: Column, turn: float, height: float) -> Column:
    """How many cells go round the earth in the band of a latitude: each as wide as the radius reaches anywhere in it."""
    edge = F.least(F.greatest(F.abs(lat * height), F.abs((lat + 1) * height)), F.lit(90.0))
    sine = math.sin(turn) / F.cos(F.radians(edge))
    return F.when(F.radians(edge) + turn < math.pi / 2, F.greatest(F.floor(F.lit(360.0) / F.degrees(F.asin(F.least(sine, F.lit(1.0))))), F.lit(1))).otherwise(F.lit(1)).cast("long")


def crowded_cells(sizes: DataFrame, dense: int, partitions: int) -> DataFrame:
    """(band, cell, lots, others) of the cells (band, cell, n, m) whose sides of n and m points are dealt to parts: of `dense`
    points, or of as many as make PARTS pairs of parts for each partition, MOST at most."""
    pairs = F.sum(F.col("n").cast("double") * F.col("m"))
    even = sizes.agg(F.greatest(F.lit(float(dense)), F.least(F.sqrt(pairs / (PARTS * partitions)), F.lit(float(MOST)))).alias("even"))
    parts = lambda of: F.greatest(F.ceil(F.col(of) / F.col("even")), F.lit(1)).cast("int")
    own = sizes.crossJoin(F.broadcast(even)).where((F.col("n") > F.col("even")) | (F.col("m") > F.col("even")))  # one row
    return own.select("band", "cell", parts("n").alias("lots"), parts("m").alias("others"))


def radius_join(points: DataFrame, metres: float, id_col: str = "outlet_id", lat: str = "lat", lon: str = "lon", dense: int = DENSE, carry: Sequence[str] = (), load: Callable[[Column], Column] = lambda of: F.lit(1)) -> DataFrame:
    """(id, other, metres, carry... of the other): all ordered pairs of different points within the radius, anywhere on earth.

    Bands of latitude are at least as high as the radius and cut into cells as wide as it reaches in them, so that a
    point's partners lie in few cells of its own band and the two beside it, round the date line and the poles too.
    Points are counted by cell first: both sides of a crowded cell are dealt to parts, of which each pair meets in one task.
    Parts have `dense` points, or as many as make PARTS pairs of parts for each partition, so that a point is moved to few of
    them however many there are. An id may stand for several points (`load`). Points without coordinates have no partner.
    """
    turn = metres / DECAY.earth  # the radius as an angle
    height = max(math.degrees(turn) * (1 + 1e-9), 1e-6)
    own = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(F.col(id_col).alias("id"), F.col(lat).cast("double").alias("y"), F.col(lon).cast("double").alias("x"), *carry)
    own = own.withColumn("band", F.floor(F.col("y") / height)).withColumn("cosine", F.cos(F.radians("y")))
    east = F.pmod(F.col("x") + 180.0, F.lit(360.0)) / 360.0
    cells = _band_cells(F.col("band"), turn, height)
    left = own.withColumn("cell", F.pmod(F.floor(east * cells), cells))
    # What a point reaches at its own latitude: half the width of the circle around it.
    reach = F.when(F.abs(F.radians("y")) + turn < math.pi / 2, F.asin(F.least(math.sin(turn) / F.col("cosine"), F.lit(1.0))) * (1 + 1e-9) / (2 * math.pi)).otherwise(F.lit(0.5))
    near = own.select(F.col("id").alias("other"), F.col("y").alias("y2"), F.col("x").alias("x2"), F.col("cosine").alias("cosine2"), *carry, east.alias("east"), reach.alias("reach"), F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)])).alias("band")).withColumn("cells", cells)
    first, last = F.floor((F.col("east") - F.col("reach")) * F.col("cells")), F.floor((F.col("east") + F.col("reach")) * F.col("cells"))
    last = F.least(last, first + F.col("cells") - 1)
    right = near.select("other", "y2", "x2", "cosine2", *carry, "band", F.explode(F.sequence(first, last)).alias("at"), "cells").withColumn("cell", F.pmod(F.col("at"), F.col("cells"))).drop("at", "cells")
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = left.groupBy("band", "cell").agg(F.sum(load(F.col("id"))).alias("n")).join(right.groupBy("band", "cell").agg(F.sum(load(F.col("other"))).alias("m")), ["band", "cell"])
    crowded = crowded_cells(sizes, dense, n)
    dealt = lambda df: df.join(crowded, ["band", "cell"], "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("lots", "others")})
    part = lambda of, n: F.pmod(F.xxhash64(of), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = dealt(left).select("id", "y", "x", "cosine", "band", "cell", part("id", "lots").alias("lot"), every("others").alias("other_lot"))
    b = dealt(right).select("other", "y2", "x2", "cosine2", *carry, "band", "cell", part("other", "others").alias("other_lot"), every("lots").alias("lot"))
    # Most candidates are told by their latitudes or by the square of half the chord; its arc decides at the very edge alone.
    square = chord(F.col("y"), F.col("x"), F.col("y2"), F.col("x2"), F.col("cosine"), F.col("cosine2"))
    far = 2 * DECAY.earth * F.asin(F.sqrt(F.least(square, F.lit(1.0))))
    edge = math.sin(min(turn / 2, math.pi / 2)) ** 2
    partners = (square <= edge * (1 + 1e-9) + 1e-18) & ((square < edge * (1 - 1e-9) - 1e-18) | (far <= metres))
    # The pairs are many more than the bytes read tell, so their parts are not merged by size.
    keys = ["band", "cell", "lot", "other_lot"]
    pairs = a.repartition(n, *keys).join(b.repartition(n, *keys).hint("merge"), keys).where((F.abs(F.col("y2") - F.col("y")) <= height) & (F.col("id") != F.col("other")) & partners)
    return pairs.select("id", "other", far.alias("metres"), *carry)


def radius_pairs(points: DataFrame, metres: float, digits: int) -> DataFrame:
    """(id, other, metres) of `radius_join`, metres rounded, of outlets of which many share a place.

    Places are joined, and their pairs taken apart where they are found: a place is moved once for all its outlets, in bundles
    of BUNDLE at most. Outlets of one bundle are no distance apart.
    """
    known = ~F.isnan(F.col("lat").cast("double")) & ~F.isnan(F.col("lon").cast("double"))
    placed = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & known).select("outlet_id", "lat", "lon")
    crowds = placed.groupBy("lat", "lon").agg(F.count("*").alias("n")).where(F.col("n") > BUNDLE)
    lot = F.pmod(F.xxhash64("outlet_id"), F.coalesce(F.ceil(F.col("n") / BUNDLE), F.lit(1))).cast("int")
    bundles = cut(placed.join(crowds, ["lat", "lon"], "left").groupBy("lat", "lon", lot.alias("lot")).agg(F.collect_list("outlet_id").alias("ids")))
    near = radius_join(bundles.select("lat", "lon", F.struct("lat", "lon", "lot", "ids").alias("bundle")), metres, "bundle", load=lambda of: F.size(of["ids"]))
    met = near.select(F.col("id")["ids"].alias("ids"), F.col("other")["ids"].alias("others"), F.round("metres", digits).alias("metres"))
    same = bundles.select("ids", F.col("ids").alias("others"), F.lit(0.0).alias("metres")).where(F.size("ids") > 1)
    apart = met.unionByName(same).select(F.explode("ids").alias("id"), "others", "metres").select("id", F.explode("others").alias("other"), "metres")
    return apart.where("id != other")


def rivals(points: DataFrame, everyone: DataFrame) -> DataFrame:
    """For every outlet: rivals within the radius, their decayed weight, the market share left; defaults without coordinates.

    Outlets at the same point have the same rivals, so points are joined once, with the number of outlets at each: what
    grows is the number of different points around a point. An outlet's own point has its others, at no distance.
    """
    placed = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("outlet_id", "lat", "lon")
    spots = cut(placed.groupBy("lat", "lon").agg(F.min("outlet_id").alias("spot"), F.count("*").alias("here")))
    near = radius_join(spots, DECAY.radius, "spot", carry=["here"])
    around = near.groupBy(F.col("id").alias("spot")).agg(F.sum("here").alias("many"), F.sum(F.col("here") * F.exp(-F.col("metres") / DECAY.rival_length)).alias("far"))
    others = F.col("here") - 1
    per = spots.join(around, "spot", "left").select("lat", "lon", (others + F.coalesce("many", F.lit(0))).alias("n"), (others + F.coalesce("far", F.lit(0.0))).alias("w"))
    located = placed.join(per, ["lat", "lon"]).select("outlet_id", "n", "w", F.lit(0).alias("imputed"))
    joined = everyone.select("outlet_id").join(located, "outlet_id", "left")
    weight = F.coalesce("w", F.lit(0.0))
    return joined.select("outlet_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_competitors"), weight.alias("competitor_weight"), (1 / (1 + weight)).alias("market_share"), F.coalesce("imputed", F.lit(1)).alias("competitor_imputed"))


def shells(kind: str) -> list[Column]:
    """The counts of each shell between rings, none negative."""
    cols = [F.col(f"{kind}_{r}") for r in DECAY.rings]
    return [clip(cols[0], 0)] + [clip(b - a, 0) for a, b in zip(cols, cols[1:], strict=False)]


def exponential(kind: str, scale: float = 1.0) -> Column:
    length = DECAY.lengths[DECAY.types.index(kind)] * scale
    return sum((n * math.exp(-m / length) for n, m in zip(shells(kind), DECAY.midpoints, strict=True)), F.lit(0.0))


def gravity(kind: str) -> Column:
    return sum((n / (m**DECAY.power + 1) for n, m in zip(shells(kind), DECAY.midpoints, strict=True)), F.lit(0.0))


def _weighted(of: dict[str, Column]) -> Column:
    return sum((w * of[t] for t, w in zip(DECAY.types, DECAY.weights, strict=True)), F.lit(0.0))


def decayed(scale: float = 1.0) -> Column:
    """The weighted total of the decayed densities at some times the decay lengths."""
    return _weighted({t: exponential(t, scale) for t in DECAY.types})


def densities(rings: DataFrame, scale: float = 1.0) -> DataFrame:
    """Decayed and gravity density of each type, and their weighted totals; null without counts."""
    exp, grav = {t: exponential(t, scale) for t in DECAY.types}, {t: gravity(t) for t in DECAY.types}
    return rings.select("outlet_id", *[exp[t].alias(f"decayed_{t}") for t in DECAY.types], decayed(scale).alias("decayed_weighted"), *[grav[t].alias(f"gravity_{t}") for t in DECAY.types], _weighted(grav).alias("gravity_weighted"))


def ring_density(rings: DataFrame) -> Column:
    """Importance-weighted count within the middle ring."""
    return sum((int(w) * F.col(f"{t}_{DECAY.rings[1]}") for t, w in zip(DECAY.types, DECAY.weights, strict=True)), F.lit(0))


def impute(df: DataFrame, cluster: Sequence[str], columns: Sequence[str], flag: str) -> DataFrame:
    """Nulls filled by the cluster's median, else the table's, else 0; flag marks the rows that had one."""
    per = df.groupBy(*cluster).agg(*[F.median(c).alias(f"__c_{c}") for c in columns])
    whole = df.agg(*[F.median(c).alias(f"__g_{c}") for c in columns])
    on = [df[c].eqNullSafe(per[c]) for c in cluster]
    joined = df.join(per, on, "left").drop(*[per[c] for c in cluster]).crossJoin(F.broadcast(whole))  # whole is one row
    missing = F.greatest(*[F.col(c).isNull() for c in columns], F.lit(False)).cast("int")
    filled = [F.coalesce(F.col(c), F.col(f"__c_{c}"), F.col(f"__g_{c}"), F.lit(0.0)).alias(c) for c in columns]
    return joined.select(*[c for c in df.columns if c not in columns], *filled, missing.alias(flag))


#: The tags by which an element counts as a type of point of interest.
POI_TAGS = (
    ("school", "amenity", "school"),
    ("university", "amenity", "university"),
    ("university", "amenity", "college"),
    ("bus_station", "amenity", "bus_station"),
    ("bus_station", "public_transport", "station"),
    ("bus_station", "highway", "bus_stop"),
    ("hospital", "amenity", "hospital"),
    ("hospital", "amenity", "clinic"),
    ("place_of_worship", "amenity", "place_of_worship"),
    ("marketplace", "amenity", "marketplace"),
    ("marketplace", "shop", "supermarket"),
    ("restaurant", "amenity", "restaurant"),
    ("restaurant", "amenity", "cafe"),
    ("restaurant", "amenity", "fast_food"),
    ("tourism", "tourism", "hotel"),
    ("tourism", "tourism", "attraction"),
    ("tourism", "tourism", "museum"),
    ("tourism", "tourism", "guest_house"),
)


def poi_counts(elements: DataFrame, rings: Sequence[int] = DECAY.rings) -> DataFrame:
    """(outlet_id, poi_type, n_<ring>...): distinct elements of each type within each radius.

    elements: outlet_id, lat, lon of the outlet; kind, element_id, elat, elon, tags (map). One element may count for
    several types; those without coordinates count for none.
    """
    rules = elements.sparkSession.createDataFrame(list(POI_TAGS), "poi_type string, key string, value string")
    far = haversine(F.col("lat"), F.col("lon"), F.col("elat"), F.col("elon"), DECAY.earth)
    tagged = elements.where(F.col("elat").isNotNull() & F.col("elon").isNotNull()).select("outlet_id", "kind", "element_id", far.alias("metres"), F.explode(F.map_entries("tags")).alias("t"))
    typed = tagged.select("outlet_id", "kind", "element_id", "metres", F.col("t.key").alias("key"), F.col("t.value").alias("value")).join(F.broadcast(rules), ["key", "value"])  # a fixed table
    return typed.groupBy("outlet_id", "poi_type").agg(*[F.count_distinct(F.when(F.col("metres") <= r, F.struct("kind", "element_id"))).alias(f"n_{r}") for r in rings])


def radius_query(lat: float, lon: float, metres: int = DECAY.rings[-1]) -> str:
    """The text of one request for all tags around a point: values of a key joined, keys and values in order."""
    keys: dict[str, set[str]] = {}
    for _, key, value in POI_TAGS:
        keys.setdefault(key, set()).add(value)
    parts = "".join(f'nwr["{k}"~"^({"|".join(sorted(v))})$"](around:{metres},{lat:.6f},{lon:.6f});' for k, v in sorted(keys.items()))
    return f"[out:json][timeout:60];({parts});out center tags;"


def map_layer(df: DataFrame, coordinates: DataFrame, value: str, box: tuple[float, float, float, float], share: float = 0.97) -> DataFrame:
    """(outlet_id, lat, lon, value, radius, r, g, b, a) of the outlets whose point lies in the box (south, north, west, east).

    Colour runs from blue to amber, radius from 60 to 300 metres, both up to the value's P97 within the box. A null value
    has neither; where the P97 is 0 or null all are of the low end.
    """
    south, north, west, east = box
    placed = coordinates.where(F.col("lat").between(south, north) & F.col("lon").between(west, east)).select("outlet_id", "lat", "lon")
    own = cut(df.select("outlet_id", F.col(value).alias("value")).join(placed, "outlet_id"))  # three passes follow
    top = quantiles(own, F.col("value"), (share,)).select(F.col("q")[0].alias("top"))
    part = F.when(F.coalesce(F.col("top"), F.lit(0.0)) <= 0, F.when(F.col("value").isNotNull(), 0.0)).otherwise(clip(F.col("value") / F.col("top"), 0.0, 1.0))
    shaded = own.crossJoin(F.broadcast(top)).withColumn("part", part)  # top is one row
    ramp = [F.floor(low + span * F.col("part")).cast("int").alias(c) for c, (low, span) in RAMP.items()]
    return shaded.select("outlet_id", "lat", "lon", "value", (60 + 240 * F.col("part")).alias("radius"), *ramp, F.lit(160).alias("a"))


#: The ramp's low end and span of each colour.
RAMP = {"r": (40, 215), "g": (120, 40), "b": (220, -160)}
