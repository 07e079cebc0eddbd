"""The retail queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandry.session import cut, shared_folder, stored
from demandry.config import BUDGET, DECAY, DOMAIN, POTENTIAL
from demandry.functions.exprs import ceil_to
from demandry.operators import budget as b
from demandry.operators import censored as cen
from demandry.operators import explain as x
from demandry.operators import models as ml
from demandry.operators import panel as p
from demandry.operators import quality as q
from demandry.operators import spatial as s
from demandry.operators.ranks import pct_ranks
from demandry.plans import features as f
from demandry.plans import oracle as o
from demandry.plans import potential as pot
from demandry.plans import reporting as rep
from demandry.plans import silver, validate
from demandry.plans import views as v
from demandry.sources import places
from demandry.streaming.quality_stream import event_quality_stream

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with SQL on top of the common expressions of plans.oracle."""

    def add(function: Callable) -> Callable:
        QUERIES[name] = function
        if sql:
            SQL[name] = o.BASE.replace("with tx as", "with recursive tx as", 1) + sql if "union all select s.rn" in sql else o.BASE + sql
        return function

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def R(expr: str, name: str | None = None, digits: int = 6) -> str:  # noqa: N802
    return f"round({expr}, {digits}) as {name or expr}"


# Quality rules


@query("dq_duplicates", f"""select order_key, line, case when rn > 1 then 'duplicate on [''outlet_id'', ''year'', ''month'', ''sku_id'']' end as failure_reason
from (select *, row_number() over (partition by outlet_id, year, month, sku_id order by order_key, line, volume, bill) as rn from dirty)""")
def dq_duplicates(spark, d):
    own = v.dirty_transactions(spark, d)
    return q.tag(own, q.duplicate_reason(["outlet_id", "year", "month", "sku_id"], ["order_key", "line", "volume", "bill"])).select("order_key", "line", q.REASON)


@query("dq_nulls", "select order_key, line, case when outlet_id is null then 'null in: outlet_id' end as failure_reason from dirty")
def dq_nulls(spark, d):
    own = v.dirty_transactions(spark, d)
    return q.tag(own, q.null_reason(own, ["outlet_id", "sku_id"])).select("order_key", "line", q.REASON)


@query("dq_ref_integrity", "select order_key, line, case when outlet_id is null or outlet_id not in (select outlet_id from outlet) then 'outlet_id not in outlets' end as failure_reason from dirty")
def dq_ref_integrity(spark, d):
    return q.reference(v.dirty_transactions(spark, d), "outlet_id", v.outlets(spark, d), "outlet_id", "outlets").select("order_key", "line", q.REASON)


@query("dq_value_range", "select order_key, line, case when not coalesce(volume >= 1e-9 and volume <= 45, false) then 'volume out of range [1e-09, 45.0]' end as failure_reason from dirty")
def dq_value_range(spark, d):
    return q.tag(v.dirty_transactions(spark, d), q.range_reason("volume", 1e-9, 45.0)).select("order_key", "line", q.REASON)


@query("dq_allowed_values", f"select order_key, line, case when year not in {o.IN(DOMAIN.years)} then 'year not in {list(DOMAIN.years)}' end as failure_reason from dirty")
def dq_allowed_values(spark, d):
    return q.tag(v.dirty_transactions(spark, d), q.allowed_reason("year", DOMAIN.years)).select("order_key", "line", q.REASON)


@query("dq_regex", "select order_key, line, case when not regexp_full_match(sku_id, 'SKU_[0-2]?[0-9]') then 'sku_id does not match SKU_[0-2]?[0-9]' end as failure_reason from dirty")
def dq_regex(spark, d):
    return q.tag(v.dirty_transactions(spark, d), q.regex_reason("sku_id", "SKU_[0-2]?[0-9]")).select("order_key", "line", q.REASON)


@query("dq_dtype", """select row_no, case when not coalesce(try_cast(coolers as double) = floor(try_cast(coolers as double)), false) then 'coolers is not int' end as failure_reason from raw_outlet""")
def dq_dtype(spark, d):
    return q.tag(v.raw_outlets(spark, d), q.type_reason("coolers", "int")).select("row_no", q.REASON)


@query("dq_geo_bounds", "select outlet_id, case when not (lat between 5.9 and 9.9 and lon between 79.5 and 82.0) then 'outside the bounding box' end as failure_reason from coord")
def dq_geo_bounds(spark, d):
    return q.tag(v.coordinates(spark, d), q.geo_reason("lat", "lon", DOMAIN.box)).select("outlet_id", q.REASON)


@query("dq_price", """, pr as (select *, case when volume > 0 then bill / volume end as price from dirty),
bd as (select sku_id, quantile_cont(price, 0.01) as lo, quantile_cont(price, 0.99) as hi, count(price) as n from pr group by sku_id)
select order_key, line, case when n > 1 and not coalesce(price between lo and hi, false) then 'price outside P1-P99 of its sku_id' end as failure_reason from pr join bd using (sku_id)""")
def dq_price(spark, d):
    return q.price_check(stored(v.dirty_transactions(spark, d).select("order_key", "line", "sku_id", "volume", "bill")), "volume", "bill", "sku_id").select("order_key", "line", q.REASON)


@query("dq_p999", """select order_key, line, case when volume > p then 'volume above P99.9 of its sku_id' end as failure_reason
from dirty join (select sku_id, quantile_cont(volume, 0.999) as p from dirty group by sku_id) using (sku_id)""")
def dq_p999(spark, d):
    return q.upper_tail(stored(v.dirty_transactions(spark, d).select("order_key", "line", "sku_id", "volume")), "volume", "sku_id").select("order_key", "line", q.REASON)


RING_SQL = "coalesce(" + ", ".join(
    f"case when least(coalesce({t}_500, 0), coalesce({t}_1000, 0), coalesce({t}_2000, 0)) < 0 or coalesce({t}_500, 0) > coalesce({t}_1000, 0) or coalesce({t}_1000, 0) > coalesce({t}_2000, 0) then 'rings of {t} not monotone' end" for t in DECAY.types
) + ")"


@query("dq_rings", f"select outlet_id, {RING_SQL} as failure_reason from ring")
def dq_rings(spark, d):
    return q.tag(v.rings(spark, d), q.ring_reason(DECAY.types, DECAY.rings)).select("outlet_id", q.REASON)


FUNNEL_SQL = f""", s1 as (
  select *, case when outlet_id is null then '1 nulls' when year not in {o.IN(DOMAIN.years)} then '2 year' when volume < 1e-9 then '4 volume' when bill < 1e-9 then '5 bill'
    when outlet_id not in (select outlet_id from outlet) then '6 outlet' end as st from dirty
), s2 as (
  select * exclude (st), coalesce(st, case when row_number() over (partition by st is null, outlet_id, year, month, sku_id, distributor_id order by volume, bill, order_key, line) > 1 then case when st is null then '8 duplicate' end end) as st from s1
), s3 as (
  select s2.* exclude (st), coalesce(st, case when volume > p then '9 outlier' end) as st from s2 left join (select sku_id, quantile_cont(volume, 0.999) as p from s2 where st is null group by sku_id) using (sku_id)
), s4 as (
  select s3.* exclude (st), coalesce(st, case when n > 1 and not (bill / volume between lo and hi) then '10 price' end, 'passed') as stage
  from s3 left join (select sku_id, quantile_cont(bill / volume, 0.01) as lo, quantile_cont(bill / volume, 0.99) as hi, count(*) as n from s3 where st is null group by sku_id) using (sku_id)
)"""


def _tagged(spark, d) -> DataFrame:
    sellers = v.seasonality(spark, d).select("distributor_id").distinct()
    return silver.clean_transactions(v.dirty_transactions(spark, d), v.outlets(spark, d), sellers)


@query("dq_funnel", FUNNEL_SQL + "select stage, count(*) as n_rows, " + o.SUM("volume") + " as volume from s4 group by stage")
def dq_funnel(spark, d):
    return _tagged(spark, d).groupBy("stage").agg(F.count("*").alias("n_rows"), F.sum(F.col("volume").cast("decimal(18,2)")).cast("double").alias("volume"))


@query("reject_buckets", FUNNEL_SQL + """, why as (select case stage when '1 nulls' then 'Missing values' when '2 year' then 'Unknown references' when '4 volume' then 'Bad quantities' when '5 bill' then 'Bad quantities'
  when '6 outlet' then 'Unknown references' when '8 duplicate' then 'Duplicates' when '9 outlier' then 'Outliers' when '10 price' then 'Price checks' end as bucket from s4 where stage <> 'passed')
select bucket, count(*) as n_rows from why group by bucket order by n_rows desc, bucket limit 12""")
def reject_buckets(spark, d):
    return rep.reject_buckets(_tagged(spark, d).where(F.col(q.REASON).isNotNull()))


MASTER_SQL = f""", fx as (
  select *, array_to_string(list_transform(string_split(lower(trim(outlet_size)), ' '), lambda w: upper(w[1]) || w[2:]), ' ') as title,
    coalesce(case trim(outlet_type) when 'MACHNERY' then 'MACHINERY' when 'BUILDNG' then 'BUILDING' when 'FURNITRE' then 'FURNITURE' else trim(outlet_type) end, 'Unknown') as kind,
    case when coolers not in {o.IN(DOMAIN.null_tokens)} then try_cast(coolers as double) end as number, row_number() over (partition by outlet_id order by row_no) as rn from raw_outlet
)"""


@query("funnel_summary", FUNNEL_SQL + MASTER_SQL + """, counts as (
  select 'transactions' as dataset, 'input' as metric, count(*) as value from s4 union all select 'transactions', 'final', count(*) filter (stage = 'passed') from s4 union all select 'transactions', 'rejected', count(*) filter (stage <> 'passed') from s4
  union all select 'outlet_master', 'input', count(*) from fx union all select 'outlet_master', 'final', count(*) filter (outlet_id is not null and rn = 1) from fx union all select 'outlet_master', 'rejected', count(*) filter (outlet_id is null or rn > 1) from fx
  union all select 'outlet_coordinates', 'input', count(*) from coord union all select 'outlet_coordinates', 'out_of_box', count(*) filter (lat = 0) from coord
  union all select 'transactions', 'ghost_outlets', count(*) from fx where outlet_id is not null and rn = 1 and outlet_id not in (select outlet_id from s4 where stage = 'passed'))
select * from counts""")
def funnel_summary(spark, d):
    """Rows in and out of each table's rules, and the outlets of the clean master that no clean sale is from."""
    passed, tagged, raw = F.col("stage") == "passed", cut(_tagged(spark, d).select("outlet_id", "stage")), v.raw_outlets(spark, d)
    places, master = silver.clean_coordinates(v.coordinates(spark, d)), silver.clean_outlets(raw)
    sizes = q.summary("outlet_master", {"final": F.count("*")}, master).unionByName(q.summary("outlet_master", {"input": F.count("*")}, raw))
    dropped = sizes.groupBy("dataset").agg(F.sum(F.when(F.col("metric") == "input", F.col("value")).otherwise(-F.col("value"))).alias("value")).select("dataset", F.lit("rejected").alias("metric"), "value")
    ghosts = master.join(tagged.where(passed).select("outlet_id"), "outlet_id", "left_anti")
    parts = [q.summary("transactions", {"input": F.count("*"), "final": F.count_if(passed), "rejected": F.count_if(~passed)}, tagged), sizes, dropped]
    parts += [q.summary("outlet_coordinates", {"input": F.count("*"), "out_of_box": F.count_if(~F.col("in_box"))}, places), q.summary("transactions", {"ghost_outlets": F.count("*")}, ghosts)]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("master_impute", MASTER_SQL + f"""select outlet_id, kind as outlet_type, case when coalesce(title in {o.IN(DOMAIN.sizes)}, false) then title else 'Medium' end as outlet_size,
  cast(case when number is null then 1 when number < 0 then 0 else floor(number) end as bigint) as coolers from fx where outlet_id is not null and rn = 1""")
def master_impute(spark, d):
    return silver.clean_outlets(v.raw_outlets(spark, d))


@query("master_audit", MASTER_SQL + f"""select row_no, 'invalid outlet_size' as failure_reason from fx where not coalesce(title in {o.IN(DOMAIN.sizes)}, false)
union all select row_no, 'null outlet_type' from fx where outlet_type is null union all select row_no, 'null coolers' from fx where number is null
union all select row_no, 'negative coolers' from fx where number < 0 union all select row_no, 'null outlet_id' from fx where outlet_id is null
union all select row_no, 'duplicate outlet_id' from fx where outlet_id is not null and rn > 1""")
def master_audit(spark, d):
    return silver.audit_outlets(v.raw_outlets(spark, d))


@query("coordinates_flag", "select outlet_id, lat, lon, lat between 5.9 and 9.9 and lon between 79.5 and 82.0 as in_box from coord")
def coordinates_flag(spark, d):
    return silver.clean_coordinates(v.coordinates(spark, d))


@query("seasonality_clean", f"select distributor_id, year, month, label, case when label = 'Unknown' then 'label not in {str(sorted(DOMAIN.labels)).replace(chr(39), chr(39) * 2)}' when rn > 1 then 'duplicate on [''distributor_id'', ''year'', ''month'']' end as failure_reason from (select *, row_number() over (partition by distributor_id, year, month, label = 'Unknown' order by row_no) as rn from label)")
def seasonality_clean(spark, d):
    labels = v.seasonality(spark, d)
    return silver.clean_seasonality(labels, labels).drop("row_no")


@query("holidays_clean", """select day, name, kind, cast(try_cast(day as date) as varchar) as date, case when try_cast(day as date) is null then 'day is not datetime' when rn > 1 then 'duplicate on [''date'', ''name'', ''kind'']' end as failure_reason
from (select *, row_number() over (partition by try_cast(day as date), name, kind, try_cast(day as date) is null order by row_no) as rn from holiday)""")
def holidays_clean(spark, d):
    return silver.clean_holidays(v.holidays(spark, d)).drop("row_no").withColumn("date", F.col("date").cast("string"))


@query("working_days", """, ok as (select distinct cast(day as date) as date, name, kind from holiday where try_cast(day as date) between date '2000-01-01' and date '2000-01-31'),
cal as (select cast(d as date) as date, isodow(d) >= 6 as weekend from range(timestamp '2000-01-01', timestamp '2000-02-01', interval 1 day) r(d))
select count(*) filter (kind = 'Public') as n_public, count(*) filter (kind = 'Bank') as n_bank, count(*) filter (kind = 'Mercantile') as n_mercantile, count(*) filter (kind = 'Poya Day') as n_poya_day, count(distinct date) as n_dates,
  (select count(*) filter (weekend) from cal) as n_weekend, (select count(*) filter (not weekend and date not in (select date from ok where kind = 'Public')) from cal) as n_working from ok""")
def working_days(spark, d):
    return silver.working_days(v.holidays(spark, d), "2000-01-01", "2000-01-31")


@query("advisory_counts", MASTER_SQL + """select 'multi_distributor' as metric, count(*) as value from (select outlet_id from tx group by outlet_id having count(distinct distributor_id) > 1)
union all select 'conflicting_type', count(*) from (select outlet_id from fx where outlet_id is not null group by outlet_id having count(distinct kind) > 1)
union all select 'no_cooler_but_large', count(*) from outlet where coolers = 0 and outlet_size in ('Large', 'Extra Large')
union all select 'ghost_outlets', count(*) from outlet where outlet_id not in (select outlet_id from tx where year = 1996)""")
def advisory_counts(spark, d):
    tx, master = v.transactions(spark, d), v.outlets(spark, d)
    many = tx.groupBy("outlet_id").agg(F.count_distinct("distributor_id").alias("n")).where("n > 1")
    conflicting = silver.conflicting_types(v.raw_outlets(spark, d))
    bare = master.where("coolers = 0 and outlet_size in ('Large', 'Extra Large')")
    ghosts = master.join(tx.where("year = 1996").select("outlet_id"), "outlet_id", "left_anti")
    one = lambda df, name: df.agg(F.lit(name).alias("metric"), F.count("*").alias("value"))
    return one(many, "multi_distributor").unionByName(one(conflicting, "conflicting_type")).unionByName(one(bare, "no_cooler_but_large")).unionByName(one(ghosts, "ghost_outlets"))


@query("ghost_outlets", "select outlet_id from outlet where outlet_id not in (select outlet_id from tx where year = 1996)")
def ghost_outlets(spark, d):
    return v.outlets(spark, d).join(v.transactions(spark, d).where("year = 1996").select("outlet_id"), "outlet_id", "left_anti").select("outlet_id")


@query("null_census", "select u.column_name, u.nulls from (select " + ", ".join(f"count(*) filter ({c} is null) as {c}" for c in ("outlet_id", "outlet_size", "outlet_type", "coolers", "row_no")) + " from raw_outlet) unpivot (nulls for column_name in (outlet_id, outlet_size, outlet_type, coolers, row_no)) u")
def null_census(spark, d):
    return q.null_census(v.raw_outlets(spark, d))


# Panel and features


@query("monthly_rollup", "select outlet_id, year, month, volume, bill, n_skus, n_tx, distributor_id from m")
def monthly_rollup(spark, d):
    return f.months_of(spark, d)


@query("primary_distributor", "select outlet_id, distributor_id, province from place")
def primary_distributor(spark, d):
    return f.places(f.profile_of(spark, d))


@query("multi_distributor", "select outlet_id, count(distinct distributor_id) as n from tx group by outlet_id having count(distinct distributor_id) > 1")
def multi_distributor(spark, d):
    return v.transactions(spark, d).groupBy("outlet_id").agg(F.count_distinct("distributor_id").alias("n")).where("n > 1")


STAT_COLUMNS = ("vol_mean", "vol_median", "vol_max", "vol_std", "vol_p75", "vol_p95", "vol_p99", "bill_mean", "vol_total", "sku_mean", "vol_cv", "price_avg")


@query("tx_stats", "select outlet_id, n_tx, n_months, " + ", ".join(R(c) for c in STAT_COLUMNS) + " from stats")
def tx_stats(spark, d):
    return rounded(p.stats(f.months_of(spark, d)), *STAT_COLUMNS)


@query("recent_trend", f"select outlet_id, {R('recent_trend')} from trend")
def recent_trend(spark, d):
    return rounded(p.recent_trend(f.months_of(spark, d)), "recent_trend")


@query("yoy_growth", f"select outlet_id, {R('yoy_growth')} from growth")
def yoy_growth(spark, d):
    return rounded(p.growth(f.months_of(spark, d), 2000), "yoy_growth")


@query("censoring_score", f"select outlet_id, {R('censoring_score')} from cens")
def censoring_score(spark, d):
    return rounded(p.censoring_score(f.months_of(spark, d)), "censoring_score")


@query("plateau_score", "select outlet_id, plateau_score from plateau")
def plateau_score(spark, d):
    return p.plateau_score(f.months_of(spark, d))


@query("structural_onehot", "select o.outlet_id, coolers, " + ", ".join(f"case when outlet_size = '{z}' then 1 else 0 end as size_{z.replace(' ', '_')}" for z in DOMAIN.sizes) + ", " + ", ".join(f"case when outlet_type = '{z}' then 1 else 0 end as type_{z}" for z in DOMAIN.types) + """,
case outlet_size when 'Small' then 1 when 'Medium' then 2 when 'Large' then 3 when 'Extra Large' then 4 else 0 end as size_ordinal, """ + R("vol_mean / greatest(coolers, 1)", "volume_per_cooler") + ", " + R("coolers / greatest(vol_mean, 1.0)", "cooler_per_volume") + " from outlet o left join stats using (outlet_id)")
def structural_onehot(spark, d):
    return rounded(f.structural(v.outlets(spark, d), p.stats(f.months_of(spark, d))), "volume_per_cooler", "cooler_per_volume")


@query("seasonality_latest", "select outlet_id, season_label from season")
def seasonality_latest(spark, d):
    return f.temporal(f.places(f.profile_of(spark, d)), v.seasonality(spark, d).where("label != 'Unknown'"))


@query("peer_cluster", "select outlet_id, cluster, poi_tier, urban from member")
def peer_cluster(spark, d):
    return f.members(spark, d, f.profile_of(spark, d)).select("outlet_id", "cluster", "poi_tier", "urban")


@query("quartile_tier", "select poi_tier, count(*) as n, min(poi_density) as low, max(poi_density) as high from member group by poi_tier")
def quartile_tier(spark, d):
    return f.members(spark, d, f.profile_of(spark, d)).groupBy("poi_tier").agg(F.count("*").alias("n"), F.min("poi_density").alias("low"), F.max("poi_density").alias("high"))


def _peers(spark, d) -> DataFrame:
    own = f.profile_of(spark, d)
    return f.peers(f.members(spark, d, own).join(own.select("outlet_id", "vol_mean", "volumes"), "outlet_id"))


@query("peer_pct_rank", f"select outlet_id, cluster_size, {R('peer_rank')} from peer")
def peer_pct_rank(spark, d):
    return rounded(_peers(spark, d).select("outlet_id", "cluster_size", "peer_rank"), "peer_rank")


@query("peer_percentiles", f"select outlet_id, {R('peer_p85')}, {R('peer_p99')}, {R('gap_to_p85')} from peer")
def peer_percentiles(spark, d):
    return rounded(_peers(spark, d).select("outlet_id", "peer_p85", "peer_p99", "gap_to_p85"), "peer_p85", "peer_p99", "gap_to_p85")


@query("order_value_rank", """select o_orderkey, round((rank() over (partition by o_orderpriority order by o_totalprice) + (count(*) over (partition by o_orderpriority, o_totalprice) - 1) / 2.0::double) / count(*) over (partition by o_orderpriority), 9) as value_rank from orders""")
def order_value_rank(spark, d):
    own = v.table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return pct_ranks(own, "o_totalprice", "value_rank", "n", ["o_orderpriority"]).select("o_orderkey", F.round("value_rank", 9).alias("value_rank"))


# Places


@query("ring_density", "select outlet_id, poi_density from density")
def ring_density(spark, d):
    rings = v.rings(spark, d)
    return rings.select("outlet_id", s.ring_density(rings).cast("long").alias("poi_density"))


@query("decay_density", "select outlet_id, " + ", ".join(R(o.exp_sql(t), f"decayed_{t}") for t in DECAY.types) + ", " + R(o.weighted_sql(o.exp_sql), "decayed_weighted") + " from ring")
def decay_density(spark, d):
    dens = s.densities(v.rings(spark, d))
    names = [c for c in dens.columns if c.startswith("decayed")]
    return rounded(dens.select("outlet_id", *names), *names)


@query("gravity_density", "select outlet_id, " + ", ".join(R(o.gravity_sql(t), f"gravity_{t}", 9) for t in DECAY.types) + ", " + R(o.weighted_sql(o.gravity_sql), "gravity_weighted", 9) + " from ring")
def gravity_density(spark, d):
    dens = s.densities(v.rings(spark, d))
    names = [c for c in dens.columns if c.startswith("gravity")]
    return rounded(dens.select("outlet_id", *names), *names, digits=9)


RIVAL_SQL = f""", near as (select a.outlet_id, {o.HAVERSINE} as metres from coord a join coord b on a.outlet_id <> b.outlet_id and abs(a.lat - b.lat) < 0.006 and abs(a.lon - b.lon) < 0.006 where a.lat <> 0 and b.lat <> 0),
rv as (select outlet_id, count(*) as n, sum(exp(-metres / {DECAY.rival_length})) as w from near where metres <= {DECAY.radius} group by outlet_id)"""


@query("competitor_radius_join", RIVAL_SQL + "select o.outlet_id, coalesce(n, 0) as n_competitors, " + R("coalesce(w, 0.0)", "competitor_weight") + ", " + R("1 / (1 + coalesce(w, 0.0))", "market_share") + ", case when c.lat = 0 then 1 else 0 end as competitor_imputed from outlet o join coord c using (outlet_id) left join rv using (outlet_id)")
def competitor_radius_join(spark, d):
    return rounded(s.rivals(v.coordinates(spark, d).where("lat != 0"), v.outlets(spark, d)), "competitor_weight", "market_share")


@query("radius_pairs", f", near as (select a.outlet_id as id, b.outlet_id as other, {o.HAVERSINE} as metres from coord a join coord b on a.outlet_id <> b.outlet_id and abs(a.lat - b.lat) < 0.01 and abs(a.lon - b.lon) < 0.01 where a.lat <> 0 and b.lat <> 0) select id, other, round(metres, 3) as metres from near where metres <= 800")
def radius_pairs(spark, d):
    return s.radius_pairs(v.coordinates(spark, d).where("lat != 0"), 800.0, 3)


@query("cluster_median_impute", """, x as (select member.outlet_id, outlet_type, province, r.school_1000::double as school, r.hospital_1000::double as hospital from member join ring r using (outlet_id)),
c as (select outlet_type, province, median(school) as cs, median(hospital) as ch from x group by outlet_type, province)
select x.outlet_id, outlet_type, province, coalesce(school, cs, (select median(school) from x), 0.0) as school, coalesce(hospital, ch, (select median(hospital) from x), 0.0) as hospital, case when school is null then 1 else 0 end as poi_imputed from x join c using (outlet_type, province)""")
def cluster_median_impute(spark, d):
    who = f.members(spark, d, f.profile_of(spark, d)).select("outlet_id", "outlet_type", "province")
    rings = v.rings(spark, d).select("outlet_id", F.col("school_1000").cast("double").alias("school"), F.col("hospital_1000").cast("double").alias("hospital"))
    return s.impute(who.join(rings, "outlet_id", "left"), ["outlet_type", "province"], ["school", "hospital"], "poi_imputed")


SPEARMAN = "select count(*) as n, round(corr(a, b), 4) as pearson, round(corr(ra, rb), 4) as spearman, round({mean}, 4) as mean_diff from (select a, b, rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0::double as ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0::double as rb from pairs)"


def _lambda_sql(scale: float) -> str:
    pairs = "select " + R(o.weighted_sql(o.exp_sql), "a") + ", " + R(o.weighted_sql(lambda t: o.exp_sql(t, scale)), "b") + " from ring where school_500 is not null"
    return f"select {scale}::double as scale, * from ({SPEARMAN.format(mean=o.AVG('a - b', 6)).replace('from pairs', f'from ({pairs})')})"


@query("lambda_spearman", " " + _lambda_sql(0.5) + " union all " + _lambda_sql(1.5))
def lambda_spearman(spark, d):
    """How the order of the decayed densities holds with half and one and a half of the decay lengths."""
    scales = {"a": 1.0, "half": 0.5, "more": 1.5}
    own = cut(v.rings(spark, d).select(*[F.round(s.decayed(scale), 6).alias(c) for c, scale in scales.items()]))
    parts = [ml.agreement(own, "a", c).withColumn("scale", F.lit(scales[c])) for c in ("half", "more")]
    return parts[0].unionByName(parts[1])


@query("poi_tag_counts", f""", tag(poi_type, key, value) as (values {o.TAGS}),
el as (select c.outlet_id, c.lat, c.lon, (e.event_id % 40 - 20) / 2000.0::double + c.lat as elat, (e.event_id % 31 - 15) / 2000.0::double + c.lon as elon, e.event_id, e.event_id % 18 as k from coord c join events e on e.user_id = c.outlet_id where c.lat <> 0),
nm as (select *, row_number() over () - 1 as k from tag), t as (select el.*, n.poi_type, 2 * 6371000.0 * asin(sqrt(least(pow(sin(radians(elat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(elat)) * pow(sin(radians(elon - lon) / 2), 2), 1.0))) as metres
  from el join nm h on el.k = h.k join tag n on n.key = h.key and n.value = h.value)
select outlet_id, poi_type, count(distinct event_id) filter (metres <= 500) as n_500, count(distinct event_id) filter (metres <= 1000) as n_1000, count(distinct event_id) filter (metres <= 2000) as n_2000 from t group by outlet_id, poi_type""")
def poi_tag_counts(spark, d):
    at = v.coordinates(spark, d).where("lat != 0")
    rules = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(x_).alias("value")) for _, k, x_ in s.POI_TAGS])
    rule = F.element_at(rules, (F.col("event_id") % len(s.POI_TAGS) + 1).cast("int"))
    events = v.table(spark, d, "events").select("event_id", "user_id")
    el = events.join(at, events.user_id == at.outlet_id).select(
        "outlet_id", "lat", "lon", F.lit("node").alias("kind"), F.col("event_id").alias("element_id"),
        ((F.col("event_id") % 40 - 20) / 2000.0 + F.col("lat")).alias("elat"), ((F.col("event_id") % 31 - 15) / 2000.0 + F.col("lon")).alias("elon"), F.create_map(rule["key"], rule["value"]).alias("tags"),
    )
    return s.poi_counts(el)


# Potential


@query("physical_max", f"select outlet_id, physical_raw, {R('physical_max')}, {R('cooler_headroom')}, capacity_breached, {R('cooler_use')} from phys")
def physical_max(spark, d):
    own = v.outlets(spark, d).join(p.stats(f.months_of(spark, d)), "outlet_id")
    got = f.physical(own).select("outlet_id", F.col("physical_raw").cast("double").alias("physical_raw"), "physical_max", "cooler_headroom", "capacity_breached", "cooler_use")
    return rounded(got, "physical_max", "cooler_headroom", "cooler_use")


@query("constraint_uplift", f"select outlet_id, {R('uplift')}, constraint_type from diag")
def constraint_uplift(spark, d):
    return rounded(pot.scored(spark, d).select("outlet_id", "uplift", "constraint_type"), "uplift")


@query("potential_formula", f"select outlet_id, province, outlet_type, outlet_size, {R('vol_mean')}, {R('floor')}, {R('ceiling')}, {R('raw')}, {R('scaled')}, {R('potential')}, winner, constraint_type from diag")
def potential_formula(spark, d):
    got = pot.scored(spark, d).select("outlet_id", "province", "outlet_type", "outlet_size", "vol_mean", "floor", "ceiling", "raw", "scaled", "potential", "winner", "constraint_type")
    return rounded(got, "vol_mean", "floor", "ceiling", "raw", "scaled", "potential")


@query("predictions", "select outlet_id, ceil(round(potential, 6) * 100) / 100 as max_monthly_litres from diag")
def predictions(spark, d):
    return pot.scored(spark, d).select("outlet_id", ceil_to(F.round("potential", 6)).alias("max_monthly_litres"))


@query("branch_winner", "select winner, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from diag group by winner")
def branch_winner(spark, d):
    return rep.value_counts(pot.scored(spark, d), "winner")


@query("clamp_counters", "select count(*) filter (potential = floor) as floor_binds, count(*) filter (scaled > ceiling) as ceiling_binds, count(*) filter (floor > ceiling) as floor_over_ceiling, count(*) filter (capacity_breached = 0 and physical_max < 1.5 * peer_p99) as physical_binds from diag")
def clamp_counters(spark, d):
    return pot.scored(spark, d).agg(
        F.count_if(F.expr("potential = floor")).alias("floor_binds"), F.count_if(F.expr("scaled > ceiling")).alias("ceiling_binds"), F.count_if(F.expr("floor > ceiling")).alias("floor_over_ceiling"),
        F.count_if((F.col("capacity_breached") == 0) & (F.col("physical_max") < POTENTIAL.ceiling * F.col("peer_p99"))).alias("physical_binds"),
    )


@query("budget_greedy", "select outlet_id, spend from greedy")
def budget_greedy(spark, d):
    return b.greedy(cut(pot.candidates(pot.scored(spark, d)).select("outlet_id", "gap", "k")), BUDGET.total, BUDGET.cap, BUDGET.step)


@query("budget_waterfill", f"select outlet_id, spend_type, {R('spend', digits=2)}, {R('increment', digits=4)} from alloc")
def budget_waterfill(spark, d):
    return pot.allocate(pot.candidates(pot.scored(spark, d))).select("outlet_id", "spend_type", "spend", F.round("increment", 4).alias("increment"))


@query("budget_by_type", f"select spend_type, count(*) as outlets, {o.SUM('spend')} as spend, round({o.SUM('increment', 6)}, 3) as increment from alloc where spend > 1 group by spend_type")
def budget_by_type(spark, d):
    return b.summary(pot.allocate(pot.candidates(pot.scored(spark, d))), "spend_type")


@query("budget_by_distributor", f"select distributor_id, count(*) as outlets, {o.SUM('spend')} as spend, round({o.SUM('increment', 6)}, 3) as increment from alloc where spend > 1 group by distributor_id")
def budget_by_distributor(spark, d):
    return b.summary(pot.allocate(pot.candidates(pot.scored(spark, d))), "distributor_id")


@query("solver_comparison", f""", two as (select a.outlet_id, a.increment as exact, c.gap * (1 - exp(-c.k * g.spend)) as greedy from alloc a join cand c using (outlet_id) join greedy g using (outlet_id))
select count(*) as outlets, round({o.SUM('exact', 6)}, 3) as exact, round({o.SUM('greedy', 6)}, 3) as greedy, round({o.SUM('greedy', 6)} / greatest({o.SUM('exact', 6)}, 1e-9), 6) as ratio from two""")
def solver_comparison(spark, d):
    frame = cut(pot.candidates(pot.scored(spark, d)))
    return b.compare(pot.allocate(frame), pot.allocate(frame, exact=False))


@query("map_layer", ", own as (select outlet_id, lat, lon, round(potential, 6) as value from diag join coord using (outlet_id) where lat between 5.9 and 9.9 and lon between 79.5 and 82.0), part as (select *, least(greatest(value / (select quantile_cont(value, 0.97) from own), 0), 1) as part from own) select outlet_id, lat, lon, value, "
  + R("60 + 240 * part", "radius") + ", cast(floor(40 + 215 * part) as int) as r, cast(floor(120 + 40 * part) as int) as g, cast(floor(220 - 160 * part) as int) as b, 160 as a from part")
def map_layer(spark, d):
    return rounded(s.map_layer(rounded(pot.scored(spark, d).select("outlet_id", "potential"), "potential"), v.coordinates(spark, d), "potential", DOMAIN.box), "radius")


# Reports

HEAD = lambda c: o.AVG(f"round({c}, 6)", 6)


def _diagnostic(spark, d) -> DataFrame:
    """Rounded, so that sums over it are the same in any order."""
    return rounded(pot.scored(spark, d), "potential", "vol_mean", digits=4)


DIAG2 = ", d2 as (select * replace (round(potential, 4) as potential, round(vol_mean, 4) as vol_mean) from diag)"


@query("headline_stats", DIAG2 + f"""select count(*) as outlets, round({o.AVG('potential', 4)}, 4) as mean, round(median(potential), 4) as median, round(min(potential), 4) as least, round(max(potential), 4) as most,
round(quantile_cont(potential, 0.95), 4) as p95, round(quantile_cont(potential, 0.99), 4) as p99, round(sum(potential), 2) as total, round(sum(vol_mean), 2) as actual, round(sum(potential) / sum(vol_mean), 4) as multiple,
round(avg(case when winner = 'floor' then 1.0::double else 0.0::double end), 6) as floor_share from d2""")
def headline_stats(spark, d):
    return rep.headline(_diagnostic(spark, d))


@query("segment_means", DIAG2 + " ".join(f"{'union all' if k else ''} select '{c}' as segment, cast({c} as varchar) as value, count(*) as outlets, round({o.AVG('potential', 4)}, 4) as mean from d2 group by {c}" for k, c in enumerate(("outlet_size", "outlet_type", "province", "urban"))))
def segment_means(spark, d):
    return rep.segments(_diagnostic(spark, d))


@query("kpi_strip", DIAG2 + f"select count(*) as outlets, round({o.AVG('potential', 4)}, 4) as mean, round(sum(potential), 2) as total, round(100 * avg(case when constraint_type = 'supply' then 1.0::double else 0.0::double end), 4) as supply_pct from d2")
def kpi_strip(spark, d):
    return rep.kpis(_diagnostic(spark, d))


@query("browse_topk", DIAG2 + "select outlet_id, province, outlet_type, distributor_id, potential, round(100 * (potential / vol_mean - 1), 4) as uplift_pct from d2 where province in ('Western', 'Central') order by potential desc, outlet_id limit 50")
def browse_topk(spark, d):
    return rep.browse(_diagnostic(spark, d), provinces=["Western", "Central"])


@query("regex_search", DIAG2 + "select outlet_id, province, outlet_type, distributor_id, potential, round(100 * (potential / vol_mean - 1), 4) as uplift_pct from d2 where regexp_matches(cast(outlet_id as varchar), '(?i)^1.*7$|mach') or regexp_matches(outlet_type, '(?i)^1.*7$|mach') or regexp_matches(distributor_id, '(?i)^1.*7$|mach') order by potential desc, outlet_id limit 50")
def regex_search(spark, d):
    return rep.browse(_diagnostic(spark, d), search="^1.*7$|mach")


@query("facets", "select distinct 'province' as facet, province as value from diag union select distinct 'distributor', distributor_id from diag where province = 'Western'")
def facets(spark, d):
    return rep.facets(pot.scored(spark, d), ["Western"])


@query("drill_down", DIAG2 + "select outlet_id, potential, winner from d2 order by potential desc, outlet_id limit 1")
def drill_down(spark, d):
    return rep.drill_down(_diagnostic(spark, d)).select("outlet_id", "potential", "winner")


@query("histogram", DIAG2 + "select floor(potential / 10.0) * 10.0 as bin, count(*) as n from d2 group by 1")
def histogram(spark, d):
    return rep.histogram(_diagnostic(spark, d), "potential", 10.0)


@query("boxplot_stats", """, j as (select m.outlet_id, outlet_type, volume from m join outlet using (outlet_id)), qq as (select outlet_type, quantile_cont(volume, 0.25) as q1, quantile_cont(volume, 0.5) as md, quantile_cont(volume, 0.75) as q3 from j group by outlet_type)
select outlet_type, round(any_value(q1), 6) as q1, round(any_value(md), 6) as median, round(any_value(q3), 6) as q3, round(min(volume) filter (volume between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)), 6) as low, round(max(volume) filter (volume between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)), 6) as high from j join qq using (outlet_type) group by outlet_type""")
def boxplot_stats(spark, d):
    return rep.box_stats(f.months_of(spark, d).join(v.outlets(spark, d).select("outlet_id", "outlet_type"), "outlet_id"), "outlet_type", "volume")


@query("seasonality_effect", f", e as (select label, count(*) as n, {o.AVG('volume')} as mean from m join label using (distributor_id, year, month) group by label) select label, n, round(mean, 6) as mean, round(100 * (mean / (select mean from e where label = 'Moderate') - 1), 6) as vs_base_pct from e")
def seasonality_effect(spark, d):
    return rep.seasonality_effect(f.months_of(spark, d), v.seasonality(spark, d))


HITS = ", best as (select outlet_id, max(volume) as best from m group by outlet_id), h as (select m.outlet_id, avg(case when volume >= 0.98 * best then 1.0::double else 0.0::double end) as hit_rate from m join best using (outlet_id) group by m.outlet_id)"


@query("peak_hit_rate", HITS + f"select h.outlet_id, p.distributor_id, {R('hit_rate')} from h join place p using (outlet_id)")
def peak_hit_rate(spark, d):
    return rounded(p.peak_hits(f.months_of(spark, d)), "hit_rate")


@query("distributor_hit_rate", HITS + f"select distributor_id, count(*) as outlets, round({o.AVG('round(hit_rate, 6)', 6)}, 4) as hit_rate, count(*) filter (hit_rate > 0.1) as over_10, count(*) filter (hit_rate > 0.3) as over_30 from h join place using (outlet_id) group by distributor_id")
def distributor_hit_rate(spark, d):
    hits = rounded(p.peak_hits(f.months_of(spark, d)), "hit_rate")
    return hits.groupBy("distributor_id").agg(F.count("*").alias("outlets"), F.round(F.sum(F.col("hit_rate").cast("decimal(18,6)")).cast("double") / F.count("*"), 4).alias("hit_rate"), F.count_if(F.expr("hit_rate > 0.1")).alias("over_10"), F.count_if(F.expr("hit_rate > 0.3")).alias("over_30"))


@query("value_counts", "select outlet_type, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from outlet group by outlet_type")
def value_counts(spark, d):
    return rep.value_counts(v.outlets(spark, d), "outlet_type")


@query("seeded_sample", "select outlet_id, outlet_type from outlet order by md5(cast(outlet_id as varchar) || '-42'), outlet_id limit 25")
def seeded_sample(spark, d):
    return rep.seeded_sample(v.outlets(spark, d).select("outlet_id", "outlet_type"), "outlet_id", 25)


# Explanations

EVIDENCE = ("outlet_id", "province", "outlet_type", "outlet_size", "coolers", "potential", "vol_mean", "floor", "trend_pct", "constraint_type")
EVIDENCE_SQL = ", ev as (select outlet_id, province, outlet_type, outlet_size, coolers, cast(round(potential, 0) as bigint) as potential, cast(round(vol_mean, 0) as bigint) as vol_mean, cast(round(floor, 0) as bigint) as floor, cast(round(recent_trend * 100, 0) as bigint) as trend_pct, constraint_type from diag)"
TEXT_SQL = """, txt as (select *, 'Potential: ' || potential || ' L a month, from ' || vol_mean || ' L on average.' || chr(10) || 'Floor: ' || floor || ' L.' || chr(10) || 'Reason: ' || case when constraint_type = 'supply' then 'sales press against what can be supplied' else 'demand sets the pace' end
  || ', with a trend of ' || trend_pct || ' %.' || chr(10) || 'Action: ' || case when constraint_type = 'supply' and coolers <= 1 then 'add a cooler' when constraint_type = 'supply' then 'raise the drop size' else 'run a promotion' end || '.' as explanation from ev)"""


def _evidence(spark, d) -> DataFrame:
    whole = lambda c: F.round(c, 0).cast("long")
    return pot.scored(spark, d).select("outlet_id", "province", "outlet_type", "outlet_size", "coolers", whole(F.col("potential")).alias("potential"), whole(F.col("vol_mean")).alias("vol_mean"), whole(F.col("floor")).alias("floor"), whole(F.col("recent_trend") * 100).alias("trend_pct"), "constraint_type")


def _texts(spark, d) -> DataFrame:
    text = x.template_text(F.col("floor"), F.col("potential"), F.col("vol_mean"), F.col("trend_pct") / 100, F.col("constraint_type") == "supply", F.col("coolers"))
    return x.explain(_evidence(spark, d), text)


@query("evidence_packet", EVIDENCE_SQL + "select outlet_id, to_json({" + ", ".join(f"'{c}': {c}" for c in EVIDENCE) + "}) as packet from ev")
def evidence_packet(spark, d):
    own = _evidence(spark, d)
    return own.select("outlet_id", F.to_json(x.evidence(*[(c, F.col(c)) for c in EVIDENCE])).cast("string").alias("packet"))


@query("template_explanation", EVIDENCE_SQL + TEXT_SQL + "select outlet_id, explanation, 'template' as source from txt")
def template_explanation(spark, d):
    return _texts(spark, d).select("outlet_id", "explanation", "source")


LOOSE_SQL = """, loose as (select outlet_id, explanation, len(list_distinct(list_filter(list_transform(regexp_extract_all(explanation, '[0-9]+(?:[.][0-9]+)?'), lambda v: cast(round(cast(v as double)) as bigint)),
lambda v: v > 1 and not (abs(v - potential) <= 2 or abs(v - vol_mean) <= 2 or abs(v - floor) <= 2 or abs(v - abs(trend_pct)) <= 2 or abs(v - coalesce(coolers, v + 9)) <= 2)))) as n_ungrounded from txt)"""


@query("groundedness", EVIDENCE_SQL + TEXT_SQL + LOOSE_SQL + "select outlet_id, n_ungrounded from loose")
def groundedness(spark, d):
    """Every number of the packet may stand in the text."""
    facts = x.allowed_numbers(*[F.col(c) for c in ("potential", "vol_mean", "floor", "trend_pct", "coolers")])
    return _texts(spark, d).select("outlet_id", F.size(x.ungrounded(F.col("explanation"), facts)).cast("long").alias("n_ungrounded"))


SHIFT = {"recent_trend": 1, "yoy_growth": 1, "censoring_score": 0.1, "plateau_norm": 0.5, "vol_cv": 0.5}


def _drivers(own: DataFrame) -> list:
    """Ups and downs of what sets an outlet apart, without a model: features less their usual values."""
    return x.top_drivers(own, list(SHIFT), of={c: F.col(c) - m for c, m in SHIFT.items()})


def _facts(spark, d) -> DataFrame:
    near = s.rivals(v.coordinates(spark, d).where("lat != 0"), v.outlets(spark, d)).select("outlet_id", "n_competitors", "market_share")
    density = s.densities(v.rings(spark, d)).select("outlet_id", "decayed_weighted")
    return x.facts(pot.scored(spark, d).join(near, "outlet_id", "left").join(density, "outlet_id", "left"))


@query("live_sample", EVIDENCE_SQL + """, top as (select outlet_id, potential from ev order by potential desc, outlet_id limit 8)
select outlet_id, potential from top union all select * from (select outlet_id, potential from ev where outlet_id not in (select outlet_id from top) order by md5(outlet_id || '-42'), outlet_id limit 17)""")
def live_sample(spark, d):
    return x.live_sample(_evidence(spark, d).select("outlet_id", "potential"), "potential", 25)


@query("top_drivers", """, z as (select outlet_id, (recent_trend - 1) as recent_trend, (yoy_growth - 1) as yoy_growth, (censoring_score - 0.1) as censoring_score, (plateau_norm - 0.5) as plateau_norm, (vol_cv - 0.5) as vol_cv from txf),
u as (select outlet_id, feature, round(value, 4) as r, value from z unpivot (value for feature in (recent_trend, yoy_growth, censoring_score, plateau_norm, vol_cv))),
o as (select *, row_number() over (partition by outlet_id, value > 0 order by abs(value) desc, feature) as rn from u where abs(value) > 1e-6)
select z.outlet_id, coalesce(string_agg(feature, ',' order by rn) filter (value > 0 and rn <= 3), '') as ups, coalesce(string_agg(feature, ',' order by rn) filter (value < 0 and rn <= 3), '') as downs from z left join o using (outlet_id) group by z.outlet_id""")
def top_drivers(spark, d):
    own = f.transactional(f.profile_of(spark, d))
    drivers = own.select("outlet_id", *_drivers(own))
    names = lambda c: F.array_join(F.transform(c, lambda e: e["feature"]), ",")
    return drivers.select("outlet_id", names("ups").alias("ups"), names("downs").alias("downs"))


DRIVER_SQL = """, z as (select outlet_id, (recent_trend - 1) as recent_trend, (yoy_growth - 1) as yoy_growth, (censoring_score - 0.1) as censoring_score, (plateau_norm - 0.5) as plateau_norm, (vol_cv - 0.5) as vol_cv from txf),
u as (select outlet_id, feature, value from z unpivot (value for feature in (recent_trend, yoy_growth, censoring_score, plateau_norm, vol_cv))),
o as (select *, row_number() over (partition by outlet_id, value > 0 order by abs(value) desc, feature) as rn from u where abs(value) > 1e-6)"""


@query("driver_example", DRIVER_SQL + f""", one as (select outlet_id from diag order by (censoring_score > {POTENTIAL.supply_bound})::int desc, potential desc, outlet_id limit 1)
select outlet_id, feature, round(value, 4) as value from o join one using (outlet_id) where rn <= 3""")
def driver_example(spark, d):
    profile = f.profile_of(spark, d)
    own = f.transactional(profile)
    return rep.driver_example(pot.scored(spark, d, own=profile), own.select("outlet_id", *_drivers(own)))


@query("evidence_facts", RIVAL_SQL + ", " + "dens as (select outlet_id, " + o.weighted_sql(o.exp_sql) + f""" as decayed_weighted from ring)
select diag.outlet_id, province, distributor_id, outlet_type, outlet_size, round_even(potential, 0) as potential, round_even(vol_max, 0) as vol_max, round_even(vol_mean, 0) as vol_mean, round_even((potential / greatest(vol_max, 1) - 1) * 100, 0) as uplift_vs_peak_pct,
  coolers::double as coolers, round_even(physical_max, 0) as physical_max, round_even(decayed_weighted, 3) as decayed_weighted, coalesce(rv.n, 0)::double as n_competitors, round_even(1 / (1 + coalesce(w, 0.0)), 2) as market_share,
  round_even(peer_rank * 100, 0) as peer_rank_pct, round_even(censoring_score * 100, 0) as months_at_ceiling_pct, constraint_type, season
from diag join (select outlet_id, peer_rank from peer) using (outlet_id) left join dens using (outlet_id) left join rv on rv.outlet_id = diag.outlet_id""")
def evidence_facts(spark, d):
    """The facts of each outlet's packet but for its drivers."""
    return _facts(spark, d)


@query("serving_view", ", " + "dens as (select outlet_id, " + o.weighted_sql(o.exp_sql) + """ as decayed_weighted from ring)
select outlet_id, ceil(round(potential, 6) * 100) / 100 as max_monthly_litres, round(decayed_weighted, 6) as decayed_weighted, lat, lon, constraint_type, round((ceil(round(potential, 6) * 100) / 100 / greatest(vol_max, 1.0) - 1) * 100, 6) as uplift_pct
from diag left join dens using (outlet_id) left join coord using (outlet_id)""")
def serving_view(spark, d):
    diagnostic = cut(pot.scored(spark, d))
    handed = diagnostic.select("outlet_id", ceil_to(F.round("potential", 6)).alias("max_monthly_litres"))
    got = rep.serving(handed, diagnostic, s.densities(v.rings(spark, d)).select("outlet_id", "decayed_weighted"), v.coordinates(spark, d))
    return rounded(got.select("outlet_id", "max_monthly_litres", "decayed_weighted", "lat", "lon", "constraint_type", "uplift_pct"), "decayed_weighted", "uplift_pct")


@query("budget_view", f"select outlet_id, distributor_id, spend_type, {R('spend', digits=2)} from alloc where spend > 1 order by spend desc, outlet_id")
def budget_view(spark, d):
    detail = pot.allocate(pot.candidates(pot.scored(spark, d)))
    return rep.budget_view(detail, detail.select("outlet_id", "spend")).select("outlet_id", "distributor_id", "spend_type", "spend")


@query("geo_log10", "select outlet_id, lat, lon, round(log10(greatest(ceil(round(potential, 6) * 100) / 100, 1.0)), 6) as log_litres from diag join coord using (outlet_id) where lat between 5.9 and 9.9 and lon between 79.5 and 82.0")
def geo_log10(spark, d):
    handed = pot.scored(spark, d).select("outlet_id", ceil_to(F.round("potential", 6)).alias("max_monthly_litres"))
    return rounded(rep.geo_points(handed, v.coordinates(spark, d), DOMAIN.box), "log_litres")


@query("outlet_trends", """, peaks as (select outlet_id, max(volume) as peak from m group by outlet_id), drawn as (select * from peaks order by md5(cast(outlet_id as varchar) || '-42'), outlet_id limit 20)
select outlet_id, round(year + (month - 1) / 12, 6) as at, volume, peak from m join drawn using (outlet_id)""")
def outlet_trends(spark, d):
    return rounded(rep.outlet_trends(f.months_of(spark, d), 20), "at")


@query("panel_counts", HITS + """select (select count(*) from h) as outlets, (select count(*) from m) as outlet_months, (select count(*) from h where hit_rate > 0.3) as near_best,
(select median(n) from (select count(*) as n from m group by outlet_id)) as median_months, (select median(volume) from m) as median_volume""")
def panel_counts(spark, d):
    return rep.panel_counts(f.profile_of(spark, d))


# Checks


@query("validation_table", """, one as (select count(*) as n, count(*) filter (potential is null) as nulls, count(*) filter (potential <= 0) as low, count(*) filter (potential < 1.05 * vol_max - 1e-6) as under,
  avg(potential) filter (urban = 1) as urban, avg(potential) filter (urban = 0) as rural, avg(potential) filter (outlet_size in ('Large', 'Extra Large')) as large, avg(potential) filter (outlet_size = 'Small') as small, (select count(distinct outlet_id) from m) as outlets from diag)
select 'V01 rows' as "check", n::double as observed, outlets::double as expected, case when n = outlets then 'PASS' else 'FAIL' end as status from one
union all select 'V02 columns', 2, 2, 'PASS' union all select 'V03 nulls', nulls, 0, case when nulls = 0 then 'PASS' else 'FAIL' end from one union all select 'V04 not positive', low, 0, case when low = 0 then 'PASS' else 'FAIL' end from one
union all select 'V05 below floor', under, 0, case when under = 0 then 'PASS' else 'FAIL' end from one
union all select 'V07 urban over rural', round(coalesce(urban, 0), 4), round(coalesce(rural, 0), 4), case when coalesce(urban, 0) > coalesce(rural, 0) then 'PASS' else 'WARN' end from one
union all select 'V07 places imputed in percent', g, 0, case when g = 0 then 'PASS' else 'WARN' end from (select round(100 * avg(case when school_500 is null then 1.0::double else 0.0::double end), 4) as g from diag join ring using (outlet_id))
union all select 'V08 large over small', round(coalesce(large, 0), 4), round(coalesce(small, 0), 4), case when coalesce(large, 0) > coalesce(small, 0) then 'PASS' else 'FAIL' end from one""")
def validation_table(spark, d):
    profile = f.profile_of(spark, d)  # a row for each outlet of the panel
    diagnostic = pot.scored(spark, d, own=profile)
    return validate.predictions(diagnostic, profile, pot.predictions(diagnostic).columns, v.rings(spark, d).select("outlet_id", F.col("school_500").isNull().cast("int").alias("imputed")))


@query("budget_validation", f""", one as (select round({o.SUM('spend')}, 2) as spent, count(*) filter (spend is null or spend < 0) as bad, count(*) filter (spend > 1) as funded from alloc)
select 'B1 columns' as "check", 2.0::double as observed, 2.0::double as expected, 'PASS' as status
union all select 'B2 outside province', n, 0, case when n = 0 then 'PASS' else 'FAIL' end from (select count(*) as n from alloc join member using (outlet_id) where province <> 'Western') union all select 'B3 within budget', spent, {BUDGET.total}, case when spent <= {BUDGET.total} + 1 then 'PASS' else 'FAIL' end from one
union all select 'B4 negative or null', bad, 0, case when bad = 0 then 'PASS' else 'FAIL' end from one union all select 'B5 funded', funded, 0, case when funded > 0 then 'PASS' else 'WARN' end from one""")
def budget_validation(spark, d):
    diagnostic = cut(pot.scored(spark, d))
    allocated = pot.allocate(pot.candidates(diagnostic))
    return validate.budget(allocated, diagnostic, allocated.select("outlet_id", "spend").columns)


@query("explanation_validation", EVIDENCE_SQL + TEXT_SQL + LOOSE_SQL + """, one as (select count(*) as n, count(*) filter (coalesce(length(explanation), 0) = 0) as empty, count(*) filter (n_ungrounded > 0) as ungrounded, (select count(*) from member where outlet_id not in (select outlet_id from loose)) as missing from loose)
select 'X1 missing' as "check", missing::double as observed, 0.0::double as expected, case when missing = 0 then 'PASS' else 'FAIL' end as status from one union all select 'X2 empty', empty, 0, case when empty = 0 then 'PASS' else 'FAIL' end from one
union all select 'X3 live texts', 0, n, 'PASS' from one union all select 'X4 ungrounded', ungrounded, 0, case when ungrounded = 0 then 'PASS' else 'FAIL' end from one""")
def explanation_validation(spark, d):
    facts = x.allowed_numbers(*[F.col(c) for c in ("potential", "vol_mean", "floor", "trend_pct", "coolers")])
    texts = _texts(spark, d).withColumn("ungrounded", x.ungrounded(F.col("explanation"), facts)).withColumn("packet", F.to_json(x.evidence(*[(c, F.col(c)) for c in EVIDENCE])))
    return validate.explanations(texts, f.places(f.profile_of(spark, d)))


@query("feature_guards", """, g as (select count(*) as n, count(distinct outlet_id) as keys, count(*) filter (vol_mean is null) as a, count(*) filter (peer_p85 is null) as b, count(*) filter (season_label is null) as c from pre),
w as (select count(*) as wanted, (select count(*) from outlet where outlet_id not in (select outlet_id from pre)) as missing from outlet)
select 'G1 rows' as "check", n::double as observed, wanted::double as expected, case when n = wanted then 'PASS' else 'FAIL' end as status from g, w
union all select 'G2 unique key', keys, n, case when keys = n then 'PASS' else 'FAIL' end from g union all select 'G3 keys missing', missing, 0, case when missing = 0 then 'PASS' else 'FAIL' end from w
union all select 'G4 nulls in vol_mean', a, 0, case when a = 0 then 'PASS' else 'WARN' end from g union all select 'G4 nulls in peer_p85', b, 0, case when b = 0 then 'PASS' else 'WARN' end from g
union all select 'G4 nulls in season_label', c, 0, case when c = 0 then 'PASS' else 'WARN' end from g""")
def feature_guards(spark, d):
    return validate.guards(cut(f.feature_table(spark, d).select("outlet_id", "vol_mean", "peer_p85", "season_label")), v.outlets(spark, d), "outlet_id", ["vol_mean", "peer_p85", "season_label"])


@query("resume_batches", "select outlet_id, outlet_type, 'b' || (outlet_id % 4) as batch from outlet")
def resume_batches(spark, d):
    """The master appended in four batches by a run that stops within the third, and by the one that goes on with it."""
    folder, own = f"{shared_folder(spark)}/batches-{uuid.uuid4().hex}", v.outlets(spark, d).select("outlet_id", "outlet_type")
    part = lambda k: own.where(F.col("outlet_id") % 4 == k)
    for k in range(2):
        places.append_batch(part(k), folder, f"b{k}")
    part(2).write.parquet(f"{folder}/rows/batch=b2")  # stopped before its commit
    for k in range(4):
        places.append_batch(part(k), folder, f"b{k}")
    return places.read_batches(spark, folder, own.schema)


# Models


@query("training_panel", f""", p99 as (select outlet_id, quantile_cont(volume, 0.99) as p99 from m group by outlet_id)
select outlet_id, year, month, {R('vol_mean')}, recent_trend_ as recent_trend, year - 1996 as year_norm, """ + ", ".join(f"case when month = {k} then 1 else 0 end as month_{k}" for k in range(1, 13)) + f""", {R('ln(1 + volume)', 'target')}
from (select m.*, s.vol_mean, round(t.recent_trend, 6) as recent_trend_ from m join p99 using (outlet_id) left join stats s using (outlet_id) left join trend t using (outlet_id) where not coalesce(m.volume >= 0.95 * p99, false))""")
def training_panel(spark, d):
    months = cut(f.months_of(spark, d))
    own = p.profile(months).select("outlet_id", "vol_mean", "recent_trend")
    return rounded(ml.training_panel(months, own, DOMAIN.years[0]), "vol_mean", "recent_trend", "target")


@query("grouped_folds", """, sizes as (select outlet_id, count(*) as n, row_number() over (order by count(*) desc) as rn from m group by outlet_id),
dealt(rn, n, fold, loads) as (
  select 0::bigint, 0::bigint, 0, [0, 0, 0, 0, 0]::bigint[]
  union all select s.rn, s.n, list_position(d.loads, list_min(d.loads)) - 1, [case when k = list_position(d.loads, list_min(d.loads)) then d.loads[k] + s.n else d.loads[k] end for k in [1, 2, 3, 4, 5]] from dealt d join sizes s on s.rn = d.rn + 1)
select fold::int as fold, sum(n)::bigint as n_rows, count(*) as outlets from dealt where rn > 0 group by fold""")
def grouped_folds(spark, d):
    """Rows and outlets of each fold, the largest outlets dealt first to the fold with the least rows."""
    return ml.balanced_folds(f.months_of(spark, d), "outlet_id").groupBy("fold").agg(F.sum("n_rows").alias("n_rows"), F.count("*").alias("outlets"))


@query("agreement_stats", ", pairs as (select round(vol_mean, 2) as a, round(vol_p95, 2) as b from stats) " + SPEARMAN.format(mean=o.AVG("a - b", 6)))
def agreement_stats(spark, d):
    return ml.agreement(p.stats(f.months_of(spark, d)).select(F.round("vol_mean", 2).alias("a"), F.round("vol_p95", 2).alias("b")), "a", "b")


#: What the models' queries read of the feature table beside its features.
BESIDE = ("province", "distributor_id", "outlet_type", "outlet_size", "vol_p95", "peer_p85", "peer_p99", "physical_max", "capacity_breached", "season_label", "poi_imputed")


def _outlets(spark, d) -> tuple[DataFrame, DataFrame]:
    """(profile with months, feature table) of the outlets, of one reading of the sales."""
    profile = f.profile_of(spark, d, timed=True)
    return profile, stored(f.feature_table(spark, d, own=profile).select("outlet_id", *f.FEATURES, *BESIDE))


#: The queries' trees are small, so that they take seconds; the operators' defaults are the full ones.
SMALL = {"rounds": 8, "rate": 0.3, "depth": 3, "leaf": 20}


def _rows(profile: DataFrame, table: DataFrame) -> tuple[DataFrame, list[str]]:
    """(assembled months with folds, names of their features)."""
    names = [*f.FEATURES, "year_norm", *[f"month_{k}" for k in range(1, 13)]]
    return cut(ml.folded_months(profile, table.select("outlet_id", *f.FEATURES), names, DOMAIN.years[0])), names


def _model(spark, d):
    """(feature table, profile, trees, names) of the one model that forecasts and is explained."""
    profile, table = _outlets(spark, d)
    rows, names = _rows(profile, table)
    rounds = ml.cv_metrics(ml.cross_validate_folds(rows, **SMALL)).first()["rounds"] or 1
    return table, profile, ml.fit_trees(rows, names, rounds, SMALL["rate"], SMALL["depth"], leaf=SMALL["leaf"]), names


CENSORED = ["n_months", "sku_mean", "price_avg"]


def _january(own: DataFrame) -> DataFrame:
    """The features of the month to be forecast."""
    return own.withColumn("year_norm", F.lit(len(DOMAIN.years))).withColumns({f"month_{k}": F.lit(int(k == 1)) for k in range(1, 13)})


@query("cv_metrics")
def cv_metrics(spark, d):
    """Folds of outlets: rounds and error of each, then those of all."""
    rows, _ = _rows(*_outlets(spark, d))
    folds = ml.cross_validate_folds(rows, **SMALL)
    whole = ml.cv_metrics(folds)
    return folds.select(F.col("fold").cast("string").alias("fold"), "best_round", F.round("rmse", 6).alias("rmse")).unionByName(whole.select(F.lit("all").alias("fold"), F.col("rounds").alias("best_round"), F.round("rmse_mean", 6).alias("rmse")))


HOLIDAY_SQL = """, ok as (select distinct cast(day as date) as date, name, kind from holiday where try_cast(day as date) between date '2000-01-01' and date '2000-01-31'),
cal as (select cast(d as date) as date, isodow(d) >= 6 as weekend from range(timestamp '2000-01-01', timestamp '2000-02-01', interval 1 day) r(d)),
days as (select count(*) filter (kind = 'Public') as n_public, count(*) filter (kind = 'Bank') as n_bank, count(*) filter (kind = 'Mercantile') as n_mercantile, count(*) filter (kind = 'Poya Day') as n_poya_day, count(distinct date) as n_dates,
  (select count(*) filter (weekend) from cal) as n_weekend, (select count(*) filter (not weekend and date not in (select date from ok where kind = 'Public')) from cal) as n_working from ok)"""
DENSITY_COLUMNS = [*[f"decayed_{t}" for t in DECAY.types], "decayed_weighted", *[f"gravity_{t}" for t in DECAY.types], "gravity_weighted"]
DENSITY_SQL = ", dens as (select outlet_id, " + ", ".join(f"{sql} as {c}" for c, sql in zip(DENSITY_COLUMNS, [*map(o.exp_sql, DECAY.types), o.weighted_sql(o.exp_sql), *map(o.gravity_sql, DECAY.types), o.weighted_sql(o.gravity_sql)], strict=True)) + " from ring)"
DENSITY_SQL += ", placed as (select outlet_type, province, dens.* from member join dens using (outlet_id)), per as (select outlet_type, province, " + ", ".join(f"median({c}) as {c}" for c in DENSITY_COLUMNS) + " from placed group by outlet_type, province)"
DENSITY_SQL += ", overall as (select " + ", ".join(f"median({c}) as {c}" for c in DENSITY_COLUMNS) + " from placed), filled as (select p.outlet_id, " + ", ".join(f"coalesce(p.{c}, per.{c}, overall.{c}, 0.0) as {c}" for c in DENSITY_COLUMNS)
DENSITY_SQL += ", case when p.decayed_school is null then 1 else 0 end as poi_imputed from placed p join per using (outlet_type, province), overall)"


@query("feature_table", RIVAL_SQL + HOLIDAY_SQL + DENSITY_SQL + "select round(columns(t.* exclude (outlet_id, outlet_type, outlet_size, distributor_id, province, poi_tier, cluster, season_label)), 6), outlet_id, outlet_type, outlet_size, distributor_id, province, poi_tier, cluster, season_label from ("
  + "select pre.* exclude (stage_a, season, uplift, floor, constraint_type, cluster_size, peer_p85, peer_p99), peer.cluster_size, peer_rank, peer.peer_p85, peer.peer_p99, gap_to_p85, filled.* exclude (outlet_id), days.*, "
  + ", ".join(f"case when outlet_size = '{z}' then 1 else 0 end as size_{z.replace(' ', '_')}" for z in DOMAIN.sizes) + ", " + ", ".join(f"case when outlet_type = '{z}' then 1 else 0 end as type_{z}" for z in DOMAIN.types)
  + ", case outlet_size when 'Small' then 1 when 'Medium' then 2 when 'Large' then 3 when 'Extra Large' then 4 else 0 end as size_ordinal, pre.vol_mean / greatest(coolers, 1) as volume_per_cooler, coolers / greatest(pre.vol_mean, 1.0) as cooler_per_volume, "
  + "coalesce(rv.n, 0) as n_competitors, coalesce(w, 0.0) as competitor_weight, 1 / (1 + coalesce(w, 0.0)) as market_share, case when coord.lat = 0 then 1 else 0 end as competitor_imputed "
  + "from pre join peer using (outlet_id) join filled using (outlet_id) join coord using (outlet_id) left join rv using (outlet_id), days) t")
def feature_table(spark, d):
    table = f.feature_table(spark, d)
    return rounded(table, *[c for c, kind in table.dtypes if kind == "double"])


@query("stage_a_gbt")
def stage_a_gbt(spark, d):
    """Potential with the trees' January forecast as stage A."""
    table, _, model, names = _model(spark, d)
    ahead = model.transform(ml.assemble(_january(table), names)).withColumn("stage_a", F.expm1("prediction"))
    return pot.predictions(pot.scored_features(ahead))


def _censored(profile: DataFrame) -> DataFrame:
    own = profile.select("outlet_id", "vol_p95", *CENSORED, F.explode("volumes").alias("volume"))
    return own.select("outlet_id", "volume", (F.col("volume") >= 0.98 * F.col("vol_p95")).cast("int").alias("censored"), *CENSORED)


@query("weibull_aft")
def weibull_aft(spark, d):
    return cen.survival(_censored(f.profile_of(spark, d)), CENSORED)


@query("tobit")
def tobit(spark, d):
    return cen.tobit(_censored(f.profile_of(spark, d)), CENSORED)


@query("tree_shap")
def tree_shap(spark, d):
    """Attributions of the January forecast of the trees that stage_a_gbt predicts with, to all their features."""
    table, _, model, names = _model(spark, d)
    return ml.attributions(_january(table), model, names)


@query("model_agreement")
def model_agreement(spark, d):
    """Both censored regressions held against the outlet's own forecast of stage A."""
    table, profile, model, names = _model(spark, d)
    stage_a = cut(model.transform(ml.assemble(_january(table), names)).select("outlet_id", F.expm1("prediction").alias("a")))
    months = _censored(profile)
    others = {"tobit": cen.tobit(months, CENSORED), "weibull": cen.survival(months, CENSORED)}
    rows = [ml.agreement(stage_a.join(df.select("outlet_id", F.col(c).alias("b")), "outlet_id"), "a", "b").withColumn("model", F.lit(c)) for c, df in others.items()]
    return rows[0].unionByName(rows[1])


@query("driver_evidence")
def driver_evidence(spark, d):
    """Each outlet's packet of 20 fields, with the features that its forecast owes most to, up and down."""
    table, _, model, names = _model(spark, d)
    shap = ml.attributions(_january(table), model, names)
    drivers = shap.select("outlet_id", *x.top_drivers(shap, names))
    packet = x.evidence(*[(c, F.col(c)) for c, _ in x.PACKET], ("ups", F.col("ups")), ("downs", F.col("downs")))
    known = table.withColumn("decayed_weighted", F.when(F.col("poi_imputed") == 0, F.col("decayed_weighted")))  # an imputed one is no fact
    return x.facts(pot.scored_features(known)).join(drivers, "outlet_id").select("outlet_id", F.to_json(packet, {"ignoreNullFields": "false"}).alias("packet"))


@query("events_dq_stream", """select cast(ts as date) as day, case when event_id is null or user_id is null or ts is null or coalesce(value < 0, false)
  or try_cast(json_extract_string(props, '$.k') as bigint) is null then 'rejected' else 'passed' end as status, count(*) as n from events where ts is not null group by all""")
def events_dq_stream(spark, d):
    return event_quality_stream(spark, d)
