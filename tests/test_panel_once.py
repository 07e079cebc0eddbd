"""What is read or grouped once for a query, and the profile that is grouped where the sales lie."""

import random

from pyspark.sql import functions as F

from demandry import queries
from demandry.functions.exprs import exact_sum
from demandry.operators import explain, panel
from demandry.operators import spatial as s
from demandry.plans import reporting
from demandry.plans import views as v


def test_exact_sum_of_any_size(spark):
    """Sums of whole units, of large numbers and of more digits, against sums of decimals."""
    rnd = random.Random(3)
    draw = [lambda: round(rnd.uniform(-1e4, 1e4), 2), lambda: rnd.uniform(-1e3, 1e3), lambda: rnd.choice([1.005, 2.675, 0.125, -1.005, 1e-9, -0.0]), lambda: rnd.uniform(1e8, 1e11), lambda: round(rnd.uniform(-9e15, 9e15), 2), lambda: rnd.choice([687194767.36, -687194767.37, 9007199254740993.0, float("nan"), None])]
    rows = [(g, draw[g % 6]()) for g in range(120) for _ in range(rnd.randint(0, 6))] + [(g, None) for g in range(120)]
    df = spark.createDataFrame(rows, "g int, x double")
    for scale, some in ((2, df), (4, df.where("abs(x) < 1e11 or x is null"))):
        old = F.sum(F.col("x").cast(f"decimal(18,{scale})")).cast("double")
        assert some.groupBy("g").agg(old.alias("a"), exact_sum(F.col("x"), scale).alias("b")).where("not (a <=> b)").count() == 0


def test_profile_of_sales_is_the_months_profile(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice([1, 2, 3, None]), rnd.choice([1999, 2000, None]), rnd.choice([1, 2, 3, 4, None]), rnd.choice(["b", "a", None]), rnd.choice(["s", "t", None]), rnd.choice([1.0, 2.5, 0.125, 5e9, None]), 1.25) for _ in range(200)]
    tx = spark.createDataFrame(rows, "outlet_id long, year long, month long, distributor_id string, sku_id string, volume double, bill double")
    plain, dealt = panel.profile(panel.monthly(tx), 2000), panel.profile_of_sales(tx, 2000)
    assert dealt.dtypes == plain.dtypes
    assert sorted(map(repr, dealt.collect())) == sorted(map(repr, plain.collect()))


def test_the_sales_are_rolled_up_once(spark, sf, monkeypatch):
    """driver_example and validation_table share the profile between their parts."""
    real, calls = v.transactions, []
    monkeypatch.setattr(v, "transactions", lambda *a: calls.append(1) or real(*a))
    for name in ("driver_example", "validation_table"):
        calls.clear()
        queries.QUERIES[name](spark, sf)
        assert len(calls) == 1, name


def test_documents_are_read_once(spark, sf, monkeypatch):
    """lambda_spearman's densities are columns of one table; outlets are parsed in all parts."""
    joined = []
    real = queries.ml.agreement
    monkeypatch.setattr(queries.ml, "agreement", lambda df, a, b: joined.append(df) or real(df, a, b))
    queries.QUERIES["lambda_spearman"](spark, sf)
    assert len(joined) == 2 and not any("Join" in df._jdf.queryExecution().optimizedPlan().toString() for df in joined)
    assert v.rings(spark, sf).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    row = s.densities(v.rings(spark, sf), 0.5).join(v.rings(spark, sf).select("outlet_id", s.decayed(0.5).alias("same")), "outlet_id").where("not (same <=> decayed_weighted)")
    assert row.count() == 0


def test_parts_read_one_table(spark):
    """segments makes one pass, live_sample reads one checkpoint."""
    own = spark.range(40).select(F.col("id").alias("outlet_id"), F.col("id").cast("double").alias("potential"), *[(F.col("id") % k).cast("string").alias(c) for k, c in enumerate(("outlet_size", "outlet_type", "province", "urban"), 2)])
    found = reporting.segments(own)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    assert {(r.segment, r.value): (r.outlets, r.mean) for r in found.collect()}["province", "3"] == (10, 21.0)
    sample = explain.live_sample(own.select("outlet_id", "potential"), "potential", 25)
    assert "Range (" not in sample._jdf.queryExecution().optimizedPlan().toString()
    assert {r.outlet_id for r in sample.collect()} >= set(range(32, 40)) and sample.count() == 25
