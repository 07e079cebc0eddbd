"""Pairs within a radius: outlets at the same place, and how many parts the points of a crowded cell are moved to."""

import random

from pyspark.sql import functions as F

from demandry.operators import spatial


def test_outlets_of_a_place_are_moved_once(spark, monkeypatch):
    """The pairs of the join of outlets, from a join of bundles of those at the same place; repeated ids, NaN and null."""
    monkeypatch.setattr(spatial, "BUNDLE", 10)
    rnd = random.Random(4)
    places = [(6.9 + rnd.uniform(0, 0.02), 79.9 + rnd.uniform(0, 0.02)) for _ in range(30)]
    points = [(k, *rnd.choice(places)) for k in range(300)] + [(300 + k, *places[0]) for k in range(60)] + [(5, *places[1]), (5, *places[2]), (7, *places[2]), (None, *places[0]), (900, None, 79.9), (901, float("nan"), 79.9), (902, float("nan"), 79.9)]
    df = spark.createDataFrame(points, "outlet_id long, lat double, lon double")
    plain = spatial.radius_join(df, 800.0, dense=20).withColumn("metres", F.round("metres", 3))
    joined, real = [], spatial.radius_join
    monkeypatch.setattr(spatial, "radius_join", lambda of, *a, **k: joined.append(of.cache()) or real(of, *a, **k))
    got = spatial.radius_pairs(df, 800.0, 3)
    assert got.dtypes == plain.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    assert joined[0].count() < 100 and max(len(r.bundle.ids) for r in joined[0].collect()) < 30


def test_points_are_moved_to_few_parts(spark):
    """Ten times the points of a cell are moved ten times as often, not a hundred times."""
    moved = []
    for n in (100_000, 1_000_000):
        cells = spark.createDataFrame([(1, 1, n, 9 * n), (1, 2, 10, 90)], "band long, cell long, n long, m long")
        parts = {r.cell: (r.lots, r.others) for r in spatial.crowded_cells(cells, 2000, 4).collect()}
        assert set(parts) == {1}
        lots, others = parts[1]
        assert lots * others >= spatial.PARTS * 4 / 2
        moved.append(n * others + 9 * n * lots)
    assert moved[1] <= 11 * moved[0]
