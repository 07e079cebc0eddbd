"""The models' queries read the sales, the documents and the places once, and get the rows that the plain steps give."""

import json

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from demandry import queries
from demandry.config import DOMAIN
from demandry.operators import models as ml
from demandry.operators import panel as p
from demandry.plans import features as f
from demandry.plans import potential as pot
from demandry.plans import views as v


@pytest.mark.parametrize("name", ["stage_a_gbt", "model_agreement", "driver_evidence"])
def test_sales_are_read_once(spark, sf, monkeypatch, name):
    calls = []
    for of in ("transactions", "rings", "coordinates"):
        monkeypatch.setattr(v, of, lambda *a, of=of, real=getattr(v, of): calls.append(of) or real(*a))
    got = queries.QUERIES[name](spark, sf)
    assert sorted(calls) == ["coordinates", "rings", "transactions"]
    if name == "driver_evidence":  # the packets' facts are those of the plain steps
        facts = {r.outlet_id: r for r in queries._facts(spark, sf).collect()}
        rows = [json.loads(r.packet) for r in got.collect()]
        assert len(rows) == len(facts)
        for row in rows:
            assert {c: row[c] for c in facts[row["outlet_id"]].asDict()} == facts[row["outlet_id"]].asDict()


def test_months_meet_their_outlets_features_and_folds(spark):
    """Rows of folded_months against training_panel and balanced_folds of the months; null volumes, years and features."""
    rows = [(o, 1998 + (o + k) % 3, 1 + k % 12, f"d{o % 3}", f"s{k}", None if (o * k) % 17 == 3 else float((o * 31 + k * k * 7) % 50), 2.0) for o in range(25) for k in range(3 + o % 9)]
    rows += [(3, None, 4, "d", "s", 9.0, 1.0), (3, 1999, None, "d", "s", 7.0, 1.0), (40, 1999, 1, "d", "s", 5.0, 1.0)]
    tx = spark.createDataFrame(rows, "outlet_id long, year long, month long, distributor_id string, sku_id string, volume double, bill double")
    own = spark.createDataFrame([(o, float(o), None if o == 4 else o * 2) for o in range(24)], "outlet_id long, a double, b long")
    names = ["a", "b", "year_norm", *[f"month_{k}" for k in range(1, 13)]]
    plain = ml.training_panel(p.monthly(tx), own, 1996)
    folds = ml.balanced_folds(plain, "outlet_id").select("outlet_id", "fold")
    listed = lambda df: sorted(map(repr, df.select(vector_to_array("features").alias("x"), "target", "fold").collect()))
    got = ml.folded_months(p.profile_of_sales(tx, 2000, timed=True), own, names, 1996)
    assert listed(got) == listed(ml.assemble(plain, names).join(folds, "outlet_id"))


def test_the_feature_table_has_the_diagnostic(spark, sf):
    """scored_features of the stored table is scored, with a stage A and without."""
    columns = ["outlet_id", "province", "potential", "winner", "constraint_type", "season", "ceiling", "physical_max", "peer_rank", "stage_a"]
    _, table = queries._outlets(spark, sf)
    ahead = table.select("outlet_id", (F.col("vol_mean") * 1.5).alias("stage_a"))
    for a, b in ((pot.scored(spark, sf), pot.scored_features(table)), (pot.scored(spark, sf, ahead), pot.scored_features(table.withColumn("stage_a", F.col("vol_mean") * 1.5)))):
        assert sorted(map(repr, a.select(columns).collect())) == sorted(map(repr, b.select(columns).collect()))
    assert DOMAIN.years[0] == 1996 and "months" not in f.feature_table(spark, sf, own=f.profile_of(spark, sf, timed=True)).columns
