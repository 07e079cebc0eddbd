"""The registered queries: their rows against DuckDB on the smallest tables, and sources and sinks."""

import datetime
import json
import math

import duckdb
import pytest

from demandry import queries as retail
from demandry.operators import quality
from demandry.sources import tables

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["dq_funnel", "dq_price", "master_audit", "working_days", "monthly_rollup", "plateau_score", "peer_pct_rank", "decay_density", "competitor_radius_join", "potential_formula", "budget_greedy", "headline_stats", "groundedness", "validation_table", "budget_waterfill", "lambda_spearman", "agreement_stats", "quartile_tier", "live_sample", "events_dq_stream", "poi_tag_counts", "feature_table", "feature_guards", "map_layer", "solver_comparison", "budget_by_distributor", "explanation_validation", "budget_validation"]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return round(float(value), 5)
    if isinstance(value, datetime.date):
        return str(value)[:10]
    return str(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda t: [("", 0.0) if v is None else (v, 0.0) if isinstance(v, str) else ("", v) for v in t])


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, sf, duck, name):
    df = retail.QUERIES[name](spark, sf)
    got = duck.execute(retail.SQL[name])
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(columns, got.fetchall())


def test_every_query_has_sql_or_is_a_model():
    assert set(retail.QUERIES) - set(retail.SQL) == {"stage_a_gbt", "weibull_aft", "tobit", "tree_shap", "cv_metrics", "model_agreement", "driver_evidence"}


def test_stream_equals_batch(spark, sf):
    from demandry.streaming.quality_stream import tag_events

    streamed = {(str(r.day), r.status): r.n for r in retail.QUERIES["events_dq_stream"](spark, sf).collect()}
    batch = tag_events(spark.read.parquet(f"{sf}/events.parquet")).selectExpr("cast(cast(ts as date) as string) d", "case when failure_reason is null then 'passed' else 'rejected' end s").groupBy("d", "s").count().collect()
    assert streamed == {(r.d, r.s): r["count"] for r in batch}


def test_sources(spark, tmp_path):
    folder = tmp_path / "raw"
    with pytest.raises(tables.SourceMissing) as missing:
        tables.require(spark, str(folder), ["transactions"])
    assert missing.value.code == 2
    folder.mkdir()
    for name, schema in tables.SCHEMAS.items():
        columns = [c.split()[0] for c in schema.split(", ")]
        (folder / f"{name}.csv").write_text(",".join(columns) + "\n" + ",".join(["NA"] * len(columns)) + "\n")
    got, report = tables.ingest(spark, str(folder))
    assert all(v is None for v in got["outlet_master"].first()) and report.where("size(missing) > 0").count() == 0
    (folder / "holiday_list.csv").unlink()
    with pytest.raises(tables.SourceMissing) as missing:
        tables.ingest(spark, str(folder))
    assert missing.value.code == 3


def test_poi_documents(spark, tmp_path):
    (tmp_path / "A1.json").write_text(json.dumps({"counts": {"school": {"500": 2}}}))
    (tmp_path / "A2.json").write_text(json.dumps({"Outlet_ID": "X", "counts": {}}))
    (tmp_path / "A3.json").write_text("{broken")
    got = {r.outlet_id: r.counts for r in tables.read_poi(spark, str(tmp_path)).collect()}
    assert got == {"A1": {"school": {"500": 2}}, "X": {}}


def test_fetch_resume_and_sinks(spark, tmp_path):
    points = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 4.0)], "outlet_id string, lat double, lon double")
    got = tables.fetch(points, lambda lat, lon: {"n": lat} if lat < 2 else None)
    assert {r.outlet_id: r.document for r in got.collect()} == {"a": '{"n": 1.0}', "b": None}
    assert [r.outlet_id for r in tables.pending(points, got.where("document is not null")).collect()] == ["b"]
    tables.write_csv(points, str(tmp_path / "csv"))
    tables.write_table(points, str(tmp_path / "parquet"))
    tables.write_documents(points, str(tmp_path / "docs"), "outlet_id")
    tables.append_log(spark, [("a", "ok", 1)], str(tmp_path / "log"))
    tables.append_log(spark, [("b", "ok", 2)], str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2 and spark.read.parquet(str(tmp_path / "parquet")).count() == 2
    assert tables.markdown({"a": 1, "b": 2.5}, "T").splitlines()[-1] == "| b | 2.50 |"
    (tmp_path / "env").write_text("# c\nA=1\nB='2'\n")
    assert tables.load_env(str(tmp_path / "env"), {"A": "0"}) == {"A": "0", "B": "2"}


def test_reshaping(spark):
    df = spark.createDataFrame([(1, "x", None)], "a int, b string, c double")
    assert quality.reconcile(df, ["c", "d", "a"]).columns == ["c", "d", "a"] and quality.numeric_only(df, ["a"]).columns == ["c"]
    assert {tuple(r) for r in quality.null_census(df).collect()} == {("a", 0), ("b", 0), ("c", 1)}
    both = quality.collect_rejects({"one": df, "two": df.drop("b")})
    assert both.count() == 2 and "stage" in both.columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_coordinates_of_large_keys(spark, tmp_path):
    """Keys whose cubes exceed 64 bits, against Python's own integers."""
    from demandry.plans import views

    keys = [0, 1, 96, 97, 99_999, 100_000, 100_001, 815_000, 899_999, 5_400_000, 3_000_000_019, 9_007_199_254_740_993]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    found = {r.outlet_id: (r.lat, r.lon) for r in views.coordinates(spark, str(tmp_path)).collect()}
    assert found == {k: (0.0, 0.0) if k % 97 == 0 else ((68000 + (k * k * 31 + k * 7919) % 1999) / 10000, (798000 + (k**3 * 17 + k * 104729 + 13) % 1997) / 10000) for k in keys}
