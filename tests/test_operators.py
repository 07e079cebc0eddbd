"""Operators on small dirty frames, against plain Python versions of what they mean."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from demandry.config import DOMAIN
from demandry.functions import exprs
from demandry.operators import budget, censored, explain, models, panel, quality, ranks, spatial
from demandry.plans import silver, validate


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_rules_tag_split_and_cover(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0), (None, "b", 3.0), (2, None, None), (3, "z", -1.0)], "id int, kind string, x double")
    tagged = quality.tag(df, quality.null_reason(df, ["id", "kind"]), quality.range_reason("x", 0.0), quality.allowed_reason("kind", ["a", "b"]))
    passed, rejected = quality.split(tagged)
    assert passed.count() + rejected.count() == df.count()
    assert {r[quality.REASON] for r in rejected.collect()} == {"null in: id", "null in: kind", "x out of range [0.0, None]"}
    with pytest.raises(ValueError):
        quality.null_reason(df, ["nope"])


def test_duplicates_keep_the_first_and_nulls_are_equal(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (5, 3), (5, 4), (6, 5)], "k int, n int")
    tagged = quality.tag(df, quality.duplicate_reason(["k"], ["n"]))
    assert {r.n for r in tagged.where("failure_reason is not null").collect()} == {2, 4}


def test_reference_null_fails(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    known = spark.createDataFrame([(1,), (None,)], "id int")
    assert {r.k for r in quality.reference(df, "k", known, "id", "known").where("failure_reason is not null").collect()} == {2, None}


@pytest.mark.parametrize(("kind", "good"), [("int", {"1", "2.0"}), ("float", {"1", "2.0", "2.5"}), ("datetime", {"2020-01-31"})])
def test_types(spark, kind, good):
    df = spark.createDataFrame([("1",), ("2.0",), ("2.5",), ("x",), (None,), ("2020-01-31",)], "v string")
    assert {r.v for r in quality.tag(df, quality.type_reason("v", kind)).where("failure_reason is null").collect()} == good


def test_price_and_tail(spark):
    data = [("a", float(v), 10.0 * v) for v in range(1, 201)] + [("a", 1.0, 1000.0), ("b", 2.0, 3.0), ("a", 0.0, 1.0)]
    df = spark.createDataFrame(data, "g string, v double, b double")
    bad = quality.price_check(df, "v", "b", "g").where("failure_reason is not null").collect()
    assert {(r.g, r.v) for r in bad} == {("a", 1.0), ("a", 0.0)} and len(bad) == 2
    assert {r.v for r in quality.upper_tail(df, "v", "g").where("failure_reason is not null").collect()} == {200.0}


def test_master_audit_and_imputation(spark):
    raw = spark.createDataFrame([(1, " small ", " MACHNERY ", "NA", 1), (2, "Huge", None, "-2", 2), (2, "LARGE", "BUILDING", "2.7", 3), (None, None, "BUILDING", "x", 4)], "outlet_id long, outlet_size string, outlet_type string, coolers string, row_no long")
    assert sorted(rows(silver.clean_outlets(raw))) == [(1, "MACHINERY", "Small", 1), (2, "Unknown", "Medium", 0)]
    found = sorted(rows(silver.audit_outlets(raw)))
    assert (2, "invalid outlet_size") in found and (3, "duplicate outlet_id") in found and (4, "null outlet_id") in found and (4, "null coolers") in found


def test_null_semantics(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, 2.0)], "a double, b double")
    got = df.select(exprs.greatest_or_null(F.col("a"), F.col("b")), exprs.least_or_null(F.col("a"), F.col("b")), exprs.clip(F.col("b"), 0.0, 1.0)).collect()
    assert [tuple(r) for r in got] == [(None, None, None), (2.0, 1.0, 1.0)]


@pytest.mark.parametrize("n", [1, 2, 5, 6, 7, 40])
def test_tier_is_qcut(spark, n):
    got = [r[0] for r in spark.range(1, n + 1).select(exprs.tier(F.col("id"), F.lit(n))).collect()]
    expected = [1] if n == 1 else (pd.qcut(pd.Series(range(1, n + 1)), 4, labels=False, duplicates="drop") + 1).tolist() if n > 3 else None
    if expected:
        assert got == expected


def test_pct_rank(spark):
    values = [1.0, 2.0, 2.0, None, 5.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = {r.i: r.p for r in df.withColumn("p", exprs.pct_rank(F.col("v"))).collect()}
    expected = pd.Series(values).rank(pct=True)
    assert all((got[i] is None and math.isnan(expected[i])) or got[i] == pytest.approx(expected[i]) for i in got)


def loop_plateau(volumes):
    if len(volumes) < 3:
        return 0
    p75, best, run = np.percentile(volumes, 75), 0, 0
    for a, b in itertools.pairwise(volumes):
        run = run + 1 if a >= p75 and b >= p75 and abs(b - a) / max(a, 1e-9) < 0.05 else 0
        best = max(best, run)
    return best


def test_panel_features_against_loops(spark):
    rng, data, months = random.Random(3), {}, []
    for outlet in range(60):
        n = rng.choice([1, 2, 3, 5, 6, 7, 12])
        volumes = [float(rng.choice([10, 10, 10.2, 10.3, 4, 0])) for _ in range(n)]
        at = sorted(rng.sample(range(1999 * 12 + 1, 2001 * 12), n))
        data[outlet] = volumes
        months += [(outlet, (t - 1) // 12, (t - 1) % 12 + 1, v, 1.0, 1, 1, "DIST_W_01") for t, v in zip(at, volumes, strict=True)]
    df = spark.createDataFrame(months, "outlet_id long, year long, month long, volume double, bill double, n_skus long, n_tx long, distributor_id string")
    plateau = dict(rows(panel.plateau_score(df)))
    trend = dict(rows(panel.recent_trend(df)))
    for outlet, volumes in data.items():
        assert plateau[outlet] == loop_plateau(volumes)
        before = sum(volumes[-6:-3])
        assert trend[outlet] == pytest.approx(sum(volumes[-3:]) / before if len(volumes) >= 6 and before > 0 else 1.0)


def test_radius_join_is_brute_force(spark):
    rng = random.Random(5)
    points = [(i, 6.8 + rng.random() * 0.05, 79.8 + rng.random() * 0.05) for i in range(150)] + [(900, None, 80.0)]
    df = spark.createDataFrame(points, "outlet_id long, lat double, lon double")

    def metres(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(h))

    expected = {(a[0], b[0]) for a in points[:-1] for b in points[:-1] if a[0] != b[0] and metres(a, b) <= 500}
    assert {(r.id, r.other) for r in spatial.radius_join(df, 500.0).collect()} == expected
    alone = {r.outlet_id: r for r in spatial.rivals(df, df).collect()}[900]
    assert (alone.n_competitors, alone.market_share, alone.competitor_imputed) == (0, 1.0, 1)


def test_poi_counts(spark):
    el = [(1, 7.0, 80.0, "node", 1, 7.0, 80.0, {"amenity": "school", "tourism": "hotel"}), (1, 7.0, 80.0, "node", 1, 7.0, 80.0, {"amenity": "school"}), (1, 7.0, 80.0, "node", 2, 7.006, 80.0, {"amenity": "school"}), (1, 7.0, 80.0, "way", 3, None, None, {"amenity": "school"})]
    df = spark.createDataFrame(el, "outlet_id long, lat double, lon double, kind string, element_id long, elat double, elon double, tags map<string,string>")
    assert sorted(rows(spatial.poi_counts(df))) == [(1, "school", 1, 2, 2), (1, "tourism", 1, 1, 1)]
    assert '"school"' not in spatial.radius_query(7, 80) and "fast_food|hospital|" in spatial.radius_query(7, 80)


def test_impute(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (3, "a", None), (4, "b", None), (5, None, None)], "outlet_id long, c string, x double")
    got = {r.outlet_id: (r.x, r.imputed) for r in spatial.impute(df, ["c"], ["x"], "imputed").collect()}
    assert got == {1: (1.0, 0), 2: (3.0, 0), 3: (2.0, 1), 4: (2.0, 1), 5: (2.0, 1)}


def loop_greedy(frame, total, cap, step):
    spend = dict.fromkeys((i for i, *_ in frame), 0.0)
    for _ in range(int(total // step)):
        best = max(((g * k * math.exp(-k * spend[i]), -i) for i, g, k in frame if g > 0 and spend[i] < cap), default=None)
        if best is None or best[0] <= 0:
            break
        spend[-best[1]] += min(step, cap - spend[-best[1]])
    return spend


@pytest.mark.parametrize(("total", "cap"), [(20_000, 5_000), (20_000, 3_500), (500_000, 4_000)])
def test_budgets(spark, total, cap):
    rng = random.Random(7)
    frame = [(i, rng.choice([0.0, 50.0, 100.0, 300.0, 301.0]), rng.choice([9e-5, 4.5e-5])) for i in range(30)]
    df = spark.createDataFrame(frame, "outlet_id long, gap double, k double")
    got = dict(rows(budget.greedy(df, total, cap, 1000)))
    assert got == pytest.approx(loop_greedy(frame, total, cap, 1000))
    best = dict(rows(budget.waterfill(df, total, cap)))
    value = lambda s: sum(g * (1 - math.exp(-k * s[i])) for i, g, k in frame)
    spent = sum(best.values())
    assert spent == pytest.approx(min(total, cap * sum(g > 0 for _, g, _ in frame)), rel=1e-6)
    assert max(best.values()) <= cap + 1e-6 and value(best) >= value(got) - 1e-6


def test_grounded_numbers(spark):
    df = spark.createDataFrame([("about 120 L, not 500 L in B12 or 3x", [118])], "t string, a array<long>")
    assert df.select(explain.ungrounded(F.col("t"), F.col("a"))).first()[0] == [500]


def test_top_drivers(spark):
    df = spark.createDataFrame([(1, 0.5, -0.2, 0.1, 0.1, 0.0)], "outlet_id long, a double, b double, month_1 double, month_2 double, z double")
    r = df.select(*explain.top_drivers(df, ["a", "b", "month_1", "month_2", "z"])).first()
    assert [(e.feature, e.value) for e in r.ups] == [("a", 0.5), ("month", 0.2)] and [e.feature for e in r.downs] == ["b"]
    assert explain.label_for("decayed_bus_station") == "nearness of bus station"


def test_attributions_add_up(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = np.where(x[:, 0] > 0, 2.0, 0.0) + x[:, 1] * (x[:, 2] > 0)
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "outlet_id long, a double, b double, c double, target double")
    model = models.fit_trees(df, ["a", "b", "c"], rounds=5, rate=0.2, depth=3, leaf=20)
    own = models.attributions(df, model, ["a", "b", "c"])
    direct = dict(rows(model.transform(models.assemble(df, ["a", "b", "c"])).select("outlet_id", "prediction")))
    for r in own.collect():
        assert r.prediction == pytest.approx(direct[r.outlet_id], abs=1e-9)
        assert r.base + r.a + r.b + r.c == pytest.approx(r.prediction, abs=1e-9)


def test_tobit_recovers_a_censored_line(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=3000)
    latent = 3 + 0.5 * x + rng.normal(scale=0.3, size=3000)
    seen = np.minimum(latent, 3.2)
    df = spark.createDataFrame([(i, float(a), float(np.expm1(s)), int(v > 3.2)) for i, (a, s, v) in enumerate(zip(x, seen, latent, strict=True))], "outlet_id long, x double, volume double, censored int")
    got = censored.tobit(df, ["x"]).toPandas().set_index("outlet_id")["tobit"]
    fitted = np.log1p(got.loc[range(3000)].to_numpy())
    slope, offset = np.polyfit(x, fitted, 1)
    assert slope == pytest.approx(0.5, abs=0.03) and offset == pytest.approx(3, abs=0.03)


def test_domain_constants():
    assert len(DOMAIN.sizes) == 4 and DOMAIN.box[0] < DOMAIN.box[1]


def test_fixed_values():
    """What results depend on, against literals."""
    from demandry.config import BUDGET, DECAY, DOMAIN, POTENTIAL
    from demandry.operators.spatial import POI_TAGS

    assert dict(zip(DECAY.types, DECAY.lengths, strict=True)) == {"bus_station": 180, "restaurant": 200, "school": 250, "marketplace": 300, "place_of_worship": 300, "university": 450, "hospital": 500, "tourism": 500}
    assert dict(zip(DECAY.types, DECAY.weights, strict=True)) == {"school": 2, "university": 1, "bus_station": 3, "hospital": 2, "place_of_worship": 1, "marketplace": 1, "restaurant": 1, "tourism": 1}
    assert POTENTIAL.season == {"Favorable": 1.3, "Moderate": 1.0, "Un-Favorable": 0.7} and (BUDGET.total, BUDGET.cap) == (5_000_000, 50_000)
    assert dict(DOMAIN.provinces)["DIST_NW"] == "North-Western"
    assert {("bus_station", "public_transport", "station"), ("restaurant", "amenity", "fast_food"), ("tourism", "tourism", "museum"), ("tourism", "tourism", "guest_house")} <= set(POI_TAGS)
    assert len(POI_TAGS) == 18 and ("school", "amenity", "kindergarten") not in POI_TAGS


def test_running_sums_and_ranks(spark):
    import random

    from demandry.operators import ranks

    rng = random.Random(3)
    data = [(k, rng.choice([1.0, 2.0, 2.5, None, rng.random()])) for k in range(400)]
    df = spark.createDataFrame(data, "id long, x double")
    got = {r.id: r.before for r in ranks.running(df.where("x is not null"), [F.col("x").desc(), F.col("id").asc()], before=F.col("x")).collect()}
    total = 0.0
    for k, x in sorted(((k, x) for k, x in data if x is not None), key=lambda p: (-p[1], p[0])):
        assert abs(got[k] - total) < 1e-9
        total += x
    mean = {r.id: r.rank for r in ranks.mean_ranks(df, "x", "rank").collect()}
    known = sorted(x for _, x in data if x is not None)
    assert all(mean[k] is None if x is None else mean[k] == known.index(x) + (known.count(x) + 1) / 2 for k, x in data)
    assert ranks.running(df.limit(0), [F.col("x").asc()], n=F.lit(1)).count() == 0


def test_cross_validation_and_saved_trees(spark, tmp_path):
    rng = __import__("random").Random(5)
    data = [(o, rng.random(), rng.random()) for o in range(60) for _ in range(8)]
    df = spark.createDataFrame([(o, a, b, 3 * a + (b > 0.5)) for o, a, b in data], "outlet_id long, a double, b double, target double")
    folds = models.cross_validate(df, ["a", "b"], rounds=6, rate=0.3, depth=3, folds=3, leaf=20)
    got = folds.collect()
    assert len(got) == 3 and sum(r.n_valid for r in got) == len(data) and all(r.n_train + r.n_valid == len(data) and 1 <= r.best_round <= 6 and 0 < r.rmse < 1 for r in got)
    rounds = models.cv_metrics(folds).first()["rounds"]
    model = models.fit_trees(df, ["a", "b"], rounds, 0.3, 3, leaf=20)
    models.save_trees(model, ["a", "b"], f"{tmp_path}/m", spark)
    again, names = models.load_trees(f"{tmp_path}/m", spark)
    sums = [m.transform(models.assemble(df, names)).agg(F.sum("prediction")).first()[0] for m in (model, again)]
    assert names == ["a", "b"] and abs(sums[0] - sums[1]) < 1e-9


def test_groundedness_of_decimals(spark):
    from demandry.operators import explain

    df = spark.createDataFrame([("At 12.5 L and 40 L, up 7.", 12.4, [("a", 40.2)]), ("At 99.6 L.", 12.4, [])], "text string, potential double, drivers array<struct<feature:string,value:double>>")
    got = df.select(explain.ungrounded(F.col("text"), explain.allowed_numbers(F.col("potential"), drivers=F.col("drivers"))).alias("n")).collect()
    assert [sorted(r.n) for r in got] == [[7], [100]]


def test_guards_and_columns(spark):
    expected = spark.createDataFrame([(1,), (2,), (3,)], "outlet_id int")
    table = spark.createDataFrame([(1, 1.0), (1, None), (2, 2.0)], "outlet_id int, x double")
    got = {r["check"]: (r.observed, r.expected, r.status) for r in validate.guards(table, expected, "outlet_id", ["x"]).collect()}
    assert got == {"G1 rows": (3, 3, "PASS"), "G2 unique key": (2, 3, "FAIL"), "G3 keys missing": (1, 0, "FAIL"), "G4 nulls in x": (1, 0, "WARN")}
    empty = {r["check"]: r.status for r in validate.guards(table.where("false"), expected, "outlet_id", ["x"]).collect()}
    assert empty == {"G1 rows": "FAIL", "G2 unique key": "PASS", "G3 keys missing": "FAIL", "G4 nulls in x": "PASS"}
    spent = spark.createDataFrame([(1, 2.0), (9, -1.0)], "outlet_id int, spend double")
    west = spark.createDataFrame([(1, "Western"), (9, "Central")], "outlet_id int, province string")
    rows = {r["check"]: r.status for r in validate.budget(spent, west, ["spend", "outlet_id"]).collect()}
    assert rows["B1 columns"] == rows["B2 outside province"] == rows["B4 negative or null"] == "FAIL" and rows["B5 funded"] == "PASS"


def test_explanation_checks(spark):
    texts = spark.createDataFrame([(1, "a", "{}", "live", []), (2, "", "{}", "template", [7]), (3, "b", None, "template", [])], "outlet_id int, explanation string, packet string, source string, ungrounded array<int>")
    got = {r["check"]: (r.observed, r.status) for r in validate.explanations(texts, spark.range(1, 5).selectExpr("int(id) outlet_id")).collect()}
    assert got == {"X1 missing": (1, "FAIL"), "X2 empty": (2, "FAIL"), "X3 live texts": (1, "PASS"), "X4 ungrounded": (1, "FAIL")}


def test_rivals_at_the_same_point(spark):
    """Many outlets at few points: rivals by brute force, from one row of the join for each pair of points."""
    points = [(k, 6.9 + (k % 3) * 0.002, 79.9 + (k % 2) * 0.003) for k in range(60)]
    df = spark.createDataFrame(points, "outlet_id long, lat double, lon double")
    near = {k: [] for k, _, _ in points}
    for r in spatial.radius_join(df, 500.0).collect():
        near[r.id].append(r.metres)
    for r in spatial.rivals(df, df).collect():
        assert r.n_competitors == len(near[r.outlet_id]) and r.competitor_weight == pytest.approx(sum(math.exp(-m / 250) for m in near[r.outlet_id]))
    spots = spark.createDataFrame([(1, 6.9, 79.9, 7), (2, 6.902, 79.9, 5)], "id long, lat double, lon double, here long")
    assert {(r.id, r.other, r.here) for r in spatial.radius_join(spots, 500.0, "id", carry=["here"]).collect()} == {(1, 2, 5), (2, 1, 7)}


def test_map_layer(spark):
    """Literal colours: 40/120/220 at the low end, 255/160/60 at the top; points off the box and null values."""
    own = spark.createDataFrame([(1, 0.0), (2, 100.0), (3, 100.0), (4, None), (5, 5.0)], "outlet_id int, v double")
    at = spark.createDataFrame([(k, 7.0 if k < 5 else 0.0, 80.0) for k in range(1, 6)], "outlet_id int, lat double, lon double")
    got = {r.outlet_id: (r.radius, r.r, r.g, r.b, r.a) for r in spatial.map_layer(own, at, "v", (5.9, 9.9, 79.5, 82.0)).collect()}
    assert got == {1: (60.0, 40, 120, 220, 160), 2: (300.0, 255, 160, 60, 160), 3: (300.0, 255, 160, 60, 160), 4: (None, None, None, None, 160)}
    flat = spatial.map_layer(own.where("outlet_id = 1"), at, "v", (5.9, 9.9, 79.5, 82.0)).collect()
    assert [(r.radius, r.r) for r in flat] == [(60.0, 40)]


def test_survival_leaves_out_constant_features(spark):
    rows = [(k % 5, float(10 + (k * 7) % 13), int(k % 4 == 0), float(k % 5), 3.0) for k in range(100)]
    panel = spark.createDataFrame(rows, "outlet_id int, volume double, censored int, a double, same double")
    got = {r.outlet_id: r.weibull for r in censored.survival(panel, ["a", "same"]).collect()}
    alone = {r.outlet_id: r.weibull for r in censored.survival(panel, ["a"]).collect()}
    assert len(got) == 5 and all(abs(got[k] - alone[k]) < 1e-9 for k in got)


def test_attributions_equal_all_subsets(spark):
    """Shapley values by summing over every subset of three features, on a tree's own covers."""
    from itertools import combinations

    rows = [(k, float(k % 7), float(k % 5), float(k % 3), float(2 * (k % 7) + (k % 5) * (k % 3))) for k in range(210)]
    df = spark.createDataFrame(rows, "outlet_id int, a double, b double, c double, target double")
    names = ["a", "b", "c"]
    model = models.fit_trees(df, names, 2, 0.5, 3, leaf=20)
    trees = models._tree_arrays(model)

    def value(nodes, x, known, at=0):
        f = nodes["feature"][at]
        if f < 0:
            return nodes["value"][at]
        left, right = nodes["left"][at], nodes["right"][at]
        if f in known:
            return value(nodes, x, known, left if x[f] <= nodes["threshold"][at] else right)
        part = nodes["cover"][left] / nodes["cover"][at]
        return part * value(nodes, x, known, left) + (1 - part) * value(nodes, x, known, right)

    for r in models.attributions(df.limit(8), model, names).collect():
        x = [float(r.outlet_id % 7), float(r.outlet_id % 5), float(r.outlet_id % 3)]
        for i, name in enumerate(names):
            others, want = [j for j in range(3) if j != i], 0.0
            for size, share in ((0, 1 / 3), (1, 1 / 6), (2, 1 / 3)):
                for known in combinations(others, size):
                    want += share * sum(w * (value(n, x, {*known, i}) - value(n, x, set(known))) for w, n in trees)
            assert abs(r[name] - want) < 1e-9


# Ranks and percentiles by ranges


def group_rows():
    rng = random.Random(11)
    rows = [("big", round(rng.lognormvariate(0, 2), 6)) for _ in range(3000)] + [("big", 1.5)] * 900 + [("ties", 4.0)] * 500 + [("ties", 5.0)]
    rows += [(None, rng.random()) for _ in range(40)] + [("one", 3.0), ("none", None), ("none", None), ("two", 1.0), ("two", 2.0), ("two", None)]
    return rows


@pytest.mark.parametrize(("accuracy", "small"), [(10_000, 50_000), (100, 50)])
def test_quantiles_are_exact(spark, accuracy, small):
    rows, shares = group_rows(), (0.0, 0.01, 0.25, 0.5, 0.85, 0.999, 1.0)
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    got = {r.g: (r.n, r.q) for r in ranks.quantiles(df, F.col("x"), shares, ["g"], accuracy, small).collect()}
    want = {r.g: (r.n, r.q) for r in df.groupBy("g").agg(F.count("x").alias("n"), F.percentile("x", F.array(*[F.lit(s) for s in shares])).alias("q")).collect()}
    assert set(got) == set(want)
    for g, (n, q) in want.items():
        assert got[g][0] == n and (got[g][1] is None) == (q is None)
        assert q is None or got[g][1] == pytest.approx(q, rel=1e-12)
    whole = ranks.quantiles(df, F.col("x"), (0.3, 0.99), (), accuracy, small).first()
    assert whole.q == pytest.approx(df.agg(F.percentile("x", F.array(F.lit(0.3), F.lit(0.99)))).first()[0], rel=1e-12)
    assert ranks.quantiles(df.limit(0), F.col("x"), (0.5,), ["g"]).collect() == []


def test_brackets_leave_most_values_out(spark):
    """Of a large group only the values near its percentiles are ranked."""
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).cast("double").alias("x"), F.lit("g").alias("g"))
    kept = []
    inner, ranks.running = ranks.running, lambda rows, *a, **k: kept.append(rows.count()) or inner(rows, *a, **k)
    try:
        q = ranks.quantiles(df, F.col("x"), (0.5, 0.99), ["g"]).first().q
    finally:
        ranks.running = inner
    assert q == pytest.approx(df.agg(F.percentile("x", F.array(F.lit(0.5), F.lit(0.99)))).first()[0])
    assert kept[0] < 2000


def test_ranks_in_groups(spark):
    rows = group_rows()
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, g string, x double").repartition(5)
    got = {r.i: (r.rank, r.size) for r in ranks.pct_ranks(df, "x", "rank", "size", ["g"]).collect()}
    want = {r.i: (r.rank, r.size) for r in df.withColumn("rank", exprs.pct_rank(F.col("x"), F.col("g"))).withColumn("size", F.expr("count(*) over (partition by g)")).collect()}
    assert got == {i: (pytest.approx(p) if p is not None else None, n) for i, (p, n) in want.items()}


def test_running_sums_in_groups_span_ranges(spark):
    df = spark.createDataFrame([("a" if i % 10 else None, i, 1 + i % 3) for i in range(2000)], "g string, i int, v int").repartition(6)
    got = {r.i: r.before for r in ranks.running(df, [F.col("i").asc()], ["g"], before=F.col("v")).collect()}
    total = {"a": 0, None: 0}
    for i in range(2000):
        g = "a" if i % 10 else None
        assert got[i] == total[g]
        total[g] += 1 + i % 3


def test_no_plan_ranks_a_group_in_one_window(spark, sf):
    from demandry import queries as retail

    for name in ("peer_pct_rank", "peer_percentiles", "dq_price", "dq_p999", "boxplot_stats", "headline_stats", "order_value_rank"):
        plan = retail.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile(" not in plan.replace("approx_percentile(", "") and "windowspecdefinition(cluster" not in plan and "windowspecdefinition(o_orderpriority" not in plan, name


# Radius join anywhere on earth


def plain_pairs(points, metres):
    y, x = np.radians([p[1] for p in points]), np.radians([p[2] for p in points])
    a = np.sin((y[:, None] - y) / 2) ** 2 + np.cos(y)[:, None] * np.cos(y) * np.sin((x[:, None] - x) / 2) ** 2
    near = 2 * 6_371_000.0 * np.arcsin(np.sqrt(np.minimum(a, 1))) <= metres
    np.fill_diagonal(near, False)
    return {(points[i][0], points[j][0]) for i, j in zip(*np.nonzero(near), strict=True)}


def test_radius_join_anywhere(spark):
    rng, points = random.Random(9), []
    for lat in (0.0, 7.0, 59.9, 75.0, -75.0, 88.0, 89.999, -90.0):
        for lon in (80.0, 179.999, -180.0):
            spread = 0.02 / max(math.cos(math.radians(lat)), 1e-4)
            points += [(len(points) + i, max(-90.0, min(90.0, lat + rng.uniform(-0.02, 0.02))), (lon + rng.uniform(-spread, spread) + 540) % 360 - 180) for i in range(60)]
    df = spark.createDataFrame([*points, (9000, None, 1.0)], "outlet_id int, lat double, lon double")
    assert {(r.id, r.other) for r in spatial.radius_join(df, 700.0, dense=10).collect()} == plain_pairs(points, 700.0)


def test_crowded_cells_are_split(spark):
    """10,000 points in one cell: every pair once, and no task with more than two parts of points."""
    rng = random.Random(10)
    points = [(i, 7.0 + rng.uniform(0, 0.004), 80.0 + rng.uniform(0, 0.004)) for i in range(10_000)]
    df = spark.createDataFrame(points, "outlet_id int, lat double, lon double")
    got = spatial.radius_join(df, 60.0, dense=1000)
    assert got.count() == len(plain_pairs(points, 60.0))
    wide = spatial.radius_join(df, 600.0, dense=1000)
    plan = wide._jdf.queryExecution().optimizedPlan().toString()
    assert "lot" in plan
    few = spark.createDataFrame(points[:300], "outlet_id int, lat double, lon double")
    pairs = [(r.id, r.other) for r in spatial.radius_join(few, 600.0, dense=20).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == plain_pairs(points[:300], 600.0)


# Censored models, folds, early stop


def test_normal_tail_is_exact():
    s = np.r_[np.linspace(-36, 8, 400), -3.0, -2.999999, 12.0]
    log_tail, mills = censored.normal_tail(s)
    want = np.array([math.log(0.5 * math.erfc(-v / math.sqrt(2))) for v in s])
    assert np.allclose(log_tail, want, rtol=1e-11, atol=1e-14)
    density = np.exp(-0.5 * s * s) / math.sqrt(2 * math.pi)
    assert np.allclose(mills, density / np.exp(want), rtol=1e-10)
    assert censored.normal_tail(np.array([-1000.0]))[1][0] == pytest.approx(1000.001, rel=1e-6)


@pytest.mark.parametrize("of", [censored.tobit_sums, censored.weibull_sums])
def test_derivatives_equal_differences(of):
    rng = np.random.default_rng(4)
    x, y, cens = np.c_[np.ones(60), rng.normal(size=(60, 2))], rng.normal(1, 1, 60), rng.random(60) < 0.4
    p = np.array([0.3, -0.2, 0.4, 0.7])
    _, gradient, hessian = of(x, y, cens, p)
    for k in range(4):
        step = np.eye(4)[k] * 1e-6
        up, down = of(x, y, cens, p + step), of(x, y, cens, p - step)
        assert gradient[k] == pytest.approx((up[0] - down[0]) / 2e-6, rel=1e-6, abs=1e-6)
        assert np.allclose(hessian[k], (up[1] - down[1]) / 2e-6, rtol=1e-5, atol=1e-5)


def test_tobit_fits_known_parameters(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(2, 20_000))
    latent = 3 + 0.5 * a - 0.25 * b + rng.normal(scale=0.4, size=20_000)
    seen = np.minimum(latent, 3.3)
    df = spark.createDataFrame(pd.DataFrame({"outlet_id": range(20_000), "volume": np.expm1(seen), "censored": (latent > 3.3).astype(int), "a": a, "b": b, "same": 1.0}))
    data = censored.table(df, ["a", "b", "same"], F.log1p)
    beta, sigma = censored.fit_tobit(data)
    assert data.names == ["a", "b"] and beta[1:] / data.spread == pytest.approx([0.5, -0.25], abs=0.02) and sigma == pytest.approx(0.4, abs=0.01)
    assert beta[0] - (beta[1:] / data.spread * data.centre).sum() == pytest.approx(3, abs=0.02)
    at = np.r_[beta / sigma, 1 / sigma]
    assert np.abs(data.evaluator(censored.tobit_sums, np.log1p)(at)[1]).max() < 1e-2
    with pytest.raises(censored.NotConverged):
        censored.fit_tobit(data, rounds=1)
    assert censored.tobit(df.limit(0), ["a"]).collect() == []


def test_survival_fits_known_parameters_and_equals_sparks(spark):
    from pyspark.ml.regression import AFTSurvivalRegression

    rng = np.random.default_rng(3)
    n, shape = 5000, 1.8
    a, b = rng.normal(size=(2, n))
    t = np.exp(4 + 0.6 * a - 0.3 * b) * rng.weibull(shape, n) + 1
    limit = np.exp(rng.normal(4.8, 0.6, n)) + 1
    df = spark.createDataFrame(pd.DataFrame({"outlet_id": range(n), "volume": np.minimum(t, limit), "censored": (t > limit).astype(int), "a": a, "b": b}))
    data = censored.table(df, ["a", "b"], lambda v: F.log(F.greatest(v, F.lit(1.0))))
    beta, found = censored.fit_weibull(data, penalty=0.0)
    assert beta[1:] / data.spread == pytest.approx([0.6, -0.3], abs=0.05) and found == pytest.approx(shape, rel=0.05)
    ready = models.assemble(df, ["a", "b"]).select("features", F.col("volume").alias("label"), (1.0 - F.col("censored")).alias("censor"))
    model = AFTSurvivalRegression(maxIter=200, tol=1e-10).fit(ready)
    assert list(model.coefficients) == pytest.approx(list(beta[1:] / data.spread), abs=1e-4) and 1 / model.scale == pytest.approx(found, rel=1e-4)
    ridged, _ = censored.fit_weibull(data, penalty=0.5)
    assert (np.abs(ridged[1:]) < np.abs(beta[1:])).all()
    got = {r.outlet_id: r.weibull for r in censored.survival(df, ["a", "b"], penalty=0.0).where("outlet_id < 3").collect()}
    assert got[0] == pytest.approx(math.exp(beta[0] + (beta[1:] * (np.array([a[0], b[0]]) - data.centre) / data.spread).sum()) * math.gamma(1 + 1 / found), rel=1e-9)


def greedy_folds(sizes, folds):
    loads, counts = [0] * folds, [0] * folds
    for size in sorted(sizes, reverse=True):
        k = loads.index(min(loads))
        loads[k] += size
        counts[k] += 1
    return loads, counts


def test_folds_are_balanced(spark):
    rng = random.Random(6)
    for _ in range(200):
        loads, size, groups = [rng.randrange(40) for _ in range(5)], rng.randrange(1, 9), rng.randrange(60)
        want = list(loads)
        for _ in range(groups):
            want[want.index(min(want))] += size
        assert [load + size * n for load, n in zip(loads, models.shares(loads, size, groups), strict=True)] == want
    sizes = {f"o{k}": rng.choice([1, 2, 3, 12, 30]) for k in range(150)} | {"huge": 400, None: 7}
    df = spark.createDataFrame([(o, j) for o, n in sizes.items() for j in range(n)], "outlet string, j int").repartition(5)
    got = models.balanced_folds(df, "outlet", 5).collect()
    assert {r.outlet: r.n_rows for r in got} == sizes
    loads = [sum(r.n_rows for r in got if r.fold == k) for k in range(5)]
    assert (loads, [sum(r.fold == k for r in got) for k in range(5)]) == greedy_folds(sizes.values(), 5)


def test_stop_after_rounds_without_gain(spark):
    assert models.stopping_round([3, 2, 1, 1.5, 1.2, 0.5], patience=2) == (3, True)
    assert models.stopping_round([3, 2, 1, 1.5, 0.5], patience=3) == (5, False)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 2))
    df = spark.createDataFrame(pd.DataFrame({"outlet_id": range(600), "a": x[:, 0], "b": x[:, 1], "target": np.sign(x[:, 0]) + rng.normal(scale=1.0, size=600)}))
    data = models.assemble(df, ["a", "b"]).select("outlet_id", "features", "target")
    train, valid = data.where("outlet_id < 400").cache(), data.where("outlet_id >= 400").cache()
    best, error, fitted = models.early_stopped(train, valid, 2000, 0.3, 3, 42, leaf=20, patience=5, first=8)
    assert fitted <= 64 and best + 5 <= fitted
    errors = models.trees(fitted, 0.3, 3, 42, 20).fit(train).evaluateEachIteration(valid, "squared")
    assert (best, True) == models.stopping_round(errors, 5) and error == pytest.approx(math.sqrt(errors[best - 1]))
    splits = models.importance(models.fit_trees(df, ["a", "b"], 3, 0.3, 3, leaf=20), ["a", "b"], spark).collect()
    assert splits[0].feature == "a" and all(r.splits > 0 for r in splits)


# Views and checks


def test_checks_tell_wrong_columns_and_guesses(spark):
    diag = spark.createDataFrame([(1, 10.0, 9.0, 1, "Large"), (2, 5.0, 4.0, 0, "Small")], "outlet_id long, potential double, vol_max double, urban int, outlet_size string")
    good = {r.check: r for r in validate.predictions(diag, diag, ["outlet_id", "max_monthly_litres"]).collect()}
    assert good["V02 columns"].status == "PASS" and good["V07 places imputed in percent"].status == "PASS"
    imputed = spark.createDataFrame([(1, 1), (2, 0)], "outlet_id long, imputed int")
    for columns, placed in ((["max_monthly_litres", "outlet_id"], 0), (["outlet_id"], 1), (["outlet_id", "max_monthly_litres", "more"], 2)):
        checks = validate.predictions(diag, diag, columns, imputed)
        bad = {r.check: r for r in checks.collect()}
        assert (bad["V02 columns"].status, bad["V02 columns"].observed) == ("FAIL", placed) and bad["V07 places imputed in percent"].observed == 50.0
        assert validate.exit_code(checks) == 1
    spent = spark.createDataFrame([(1, 5.0)], "outlet_id long, spend double")
    own = diag.withColumn("province", F.lit("Western"))
    assert {r.check: r.status for r in validate.budget(spent, own, ["spend", "outlet_id"]).collect()}["B1 columns"] == "FAIL"
    fine = validate.budget(spent, own)
    assert {r.status for r in fine.collect()} == {"PASS"} and validate.exit_code(validate.all_checks(fine, None)) == 0


def test_a_provider_answers_first(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "outlet_id long, t string")
    provider = lambda d: d.withColumn("live_text", F.when(F.col("outlet_id") == 1, F.concat(F.lit("live "), "t")))
    assert {(r.outlet_id, r.explanation, r.source) for r in explain.explain(df, F.col("t"), provider).collect()} == {(1, "live a", "live"), (2, "b", "template")}
    said = df.select(explain.prompt(explain.evidence(("outlet_id", F.col("outlet_id")), ("t", F.col("t"))))).first()[0]
    assert said.endswith('{"outlet_id":1,"t":"a"}')


def test_packets_round_halves_to_even(spark):
    row = {"outlet_id": 1, "province": None, "distributor_id": "d", "outlet_type": "t", "outlet_size": "s", "potential": 2.5, "vol_max": 1.5, "vol_mean": 0.5, "coolers": 3, "physical_max": None, "decayed_weighted": 0.0625, "n_competitors": 2, "market_share": 0.125, "peer_rank": 0.985, "censoring_score": 0.045, "constraint_type": "supply", "season": 1.3}
    df = spark.createDataFrame([tuple(row.values())], "outlet_id long, province string, distributor_id string, outlet_type string, outlet_size string, potential double, vol_max double, vol_mean double, coolers long, physical_max double, decayed_weighted double, n_competitors long, market_share double, peer_rank double, censoring_score double, constraint_type string, season double")
    got = explain.facts(df).first().asDict()
    assert len(got) == 18 and (got["potential"], got["vol_max"], got["vol_mean"], got["market_share"], got["decayed_weighted"], got["physical_max"], got["province"]) == (2.0, 2.0, 0.0, 0.12, 0.062, None, "Unknown")


def test_serving_and_budget_views(spark):
    from demandry.plans import reporting

    handed = spark.createDataFrame([(1, 30.0), (2, 8.0)], "outlet_id long, max_monthly_litres double")
    diag = spark.createDataFrame([(1, 20.0, 0.2, "kept")], "outlet_id long, vol_max double, censoring_score double, note string")
    extra = spark.createDataFrame([(1, "other", 7)], "outlet_id long, note string, coolers int")
    at = spark.createDataFrame([(2, 7.0, 80.0)], "outlet_id long, lat double, lon double")
    got = {r.outlet_id: r for r in reporting.serving(handed, diag, extra, at).collect()}
    assert (got[1].note, got[1].coolers, got[1].constraint_type, got[1].uplift_pct, got[1].lat) == ("kept", 7, "supply", 50.0, None)
    assert (got[2].constraint_type, got[2].uplift_pct, got[2].lat) == (None, None, 7.0) or got[2].uplift_pct == 700.0
    bare = spark.createDataFrame([(1, 5.0), (2, 0.5), (3, 9.0)], "outlet_id long, spend double")
    assert [r.outlet_id for r in reporting.budget_view(None, bare).collect()] == [3, 1]
    assert reporting.budget_view(bare.withColumn("spend_type", F.lit("x")), bare).columns == ["outlet_id", "spend", "spend_type"]


def test_profile_has_the_first_rows(spark):
    from demandry.sources import tables

    got = tables.profile(spark.range(9).select("id", F.lit(None).cast("string").alias("n")).coalesce(1), "t").first()
    assert got.n_rows == 9 and got.head == ['{"id":0,"n":null}', '{"id":1,"n":null}', '{"id":2,"n":null}'] and got.columns == "id:bigint, n:string"


def test_conflicting_types(spark):
    raw = spark.createDataFrame([(1, "a", " MACHNERY "), (1, "a", "MACHINERY"), (2, "a", "x"), (2, "a", "y"), (None, "a", "z")], "outlet_id long, outlet_size string, outlet_type string").withColumn("coolers", F.lit("1"))
    assert [r.outlet_id for r in silver.conflicting_types(raw).collect()] == [2]


def test_clusters_need_a_shared_folder():
    from types import SimpleNamespace

    from demandry.session import shared_folder

    made = []
    fake = lambda master, folder=None: SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=made.append))
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_folder(fake(master))
    assert shared_folder(fake("yarn", "hdfs:///shared/")) == "hdfs:///shared" and shared_folder(fake("local[4]")) in made


def test_monthly_with_nulls(spark):
    """Null years, months, skus and distributors, ties and mixed outlets, against a plain count."""
    rnd = random.Random(5)
    rows = [(rnd.choice([1, 2, None]), rnd.choice([1999, 2000, 0, None]), rnd.choice([1, 0, None]), rnd.choice(["b", "a", "c", None, None]), rnd.choice(["s", "t", None]), float(rnd.randint(1, 9)), 1.25) for _ in range(300)]
    df = spark.createDataFrame(rows, "outlet_id long, year long, month long, distributor_id string, sku_id string, volume double, bill double")
    groups = {}
    for o, y, m, *rest in rows:
        if o is not None:
            groups.setdefault((o, y, m), []).append(rest)
    expected = {}
    for key, own in groups.items():
        names = [d for d, *_ in own if d is not None]
        mode = min(names, key=lambda d: (-names.count(d), d)) if names else None
        expected[key] = (sum(v for _, _, v, _ in own), sum(b for *_, b in own), len({s for _, s, _, _ in own} - {None}), len(own), mode)
    found = [((r.outlet_id, r.year, r.month), (r.volume, r.bill, r.n_skus, r.n_tx, r.distributor_id)) for r in panel.monthly(df).collect()]
    assert len(found) == len(expected) and dict(found) == expected
    assert dict(panel.monthly(df).dtypes)["year"] == "bigint"


def test_with_quantiles_few_and_many_groups(spark, monkeypatch):
    """Few groups are broadcast, many aren't; null groups have percentiles of their own, in df or in another table."""
    df = spark.createDataFrame([(k, None if k % 3 == 0 else f"g{k % 3}", float(k)) for k in range(30)], "id long, g string, v double")
    expected = {k: round(float(np.percentile([x for x in range(30) if x % 3 == k % 3], 90)), 6) for k in range(30)}
    for few in (100_000, 0):
        monkeypatch.setattr(ranks, "FEW", few)
        out = ranks.with_quantiles(df, F.col("v"), (0.9,), "g", "q", "n")
        assert ("strategy=broadcast" in out._jdf.queryExecution().optimizedPlan().toString()) is bool(few)
        assert {r.id: round(r.q[0], 6) for r in out.collect()} == expected and {r.n for r in out.collect()} == {10}
    other = ranks.with_quantiles(df, F.col("v"), (0.5,), "g", "q", of=df.where("g = 'g1'")).collect()
    assert len(other) == 30 and all((r.q is None) == (r.g != "g1") for r in other)
