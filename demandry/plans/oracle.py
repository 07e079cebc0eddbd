"""The same views and features in DuckDB SQL, as common table expressions that the queries' SQL builds on."""

from __future__ import annotations

from demandry.config import BUDGET, DECAY, DOMAIN, POTENTIAL
from demandry.operators.spatial import POI_TAGS
from demandry.plans.views import KINDS, PREFIXES

ARR = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
IN = lambda xs: "(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in xs) + ")"
DIST = lambda n: f"(({ARR(PREFIXES)})[cast({n} % 4 + 1 as int)] || '_' || lpad(cast({n} % 10 as varchar), 2, '0'))"
SUM = lambda x, s=2: f"cast(sum(cast({x} as decimal(18,{s}))) as double)"
AVG = lambda x, s=2: f"({SUM(x, s)} / count({x}))"


def _ring(k: str, n: int) -> list[str]:
    a = f"(({k} * 7 + {n * 3}) % 5)"
    b = f"({a} + ({k} * 11 + {n}) % 7)"
    c = f"({b} + ({k} * 13 + {n * 5}) % 11)"
    return [f"(case when {k} % 83 = 0 then {b} + 1 else {a} end)", b, c]


#: Fixed values, written out again so that the SQL doesn't follow a wrong constant: decay lengths in metres, weights.
LENGTHS = {"school": 250.0, "university": 450.0, "bus_station": 180.0, "hospital": 500.0, "place_of_worship": 300.0, "marketplace": 300.0, "restaurant": 200.0, "tourism": 500.0}
WEIGHTS = {"school": 2.0, "university": 1.0, "bus_station": 3.0, "hospital": 2.0, "place_of_worship": 1.0, "marketplace": 1.0, "restaurant": 1.0, "tourism": 1.0}
RING_COLUMNS = ", ".join(f"case when c_custkey % 9 <> 0 then {x} end as {t}_{r}" for n, t in enumerate(DECAY.types) for r, x in zip(DECAY.rings, _ring("c_custkey", n), strict=True))


def shell_sql(kind: str) -> list[str]:
    cols = [f"{kind}_{r}" for r in DECAY.rings]
    clip = lambda x: f"case when {x} is not null then greatest({x}, 0) end"
    return [clip(cols[0])] + [clip(f"{b} - {a}") for a, b in zip(cols, cols[1:], strict=False)]


def exp_sql(kind: str, scale: float = 1.0) -> str:
    length = LENGTHS[kind] * scale
    import math

    return "(0.0::double + " + " + ".join(f"({n}) * {math.exp(-m / length)!r}::double" for n, m in zip(shell_sql(kind), DECAY.midpoints, strict=True)) + ")"


def gravity_sql(kind: str) -> str:
    return "(0.0::double + " + " + ".join(f"({n}) / {m**DECAY.power + 1!r}::double" for n, m in zip(shell_sql(kind), DECAY.midpoints, strict=True)) + ")"


def weighted_sql(of) -> str:
    return "(0.0::double + " + " + ".join(f"{w!r}::double * {of(t)}" for t, w in WEIGHTS.items()) + ")"


PROVINCE = lambda d: "case " + " ".join(f"when starts_with({d}, '{p}_') then '{n}'" for p, n in DOMAIN.provinces) + " else 'Unknown' end"
HAVERSINE = "2 * 6371000.0 * asin(sqrt(least(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2), 1.0)))"
#: The allowed null tokens and the reasons' texts, as in the rules.
KEYS = "['outlet_id', 'year', 'month', 'sku_id', 'distributor_id']"

BASE = f"""
with tx as (
  select o.o_custkey as outlet_id, cast(year(o_orderdate) as bigint) as year, cast(month(o_orderdate) as bigint) as month, {DIST("l_suppkey")} as distributor_id,
    'SKU_' || cast(l_partkey % 40 as varchar) as sku_id, l_quantity as volume, l_extendedprice as bill, l_orderkey as order_key, cast(l_linenumber as bigint) as line
  from lineitem join orders o on l_orderkey = o.o_orderkey
), dirty as (
  select case when (order_key * 7 + line * 3) % 101 = 0 then null when (order_key * 7 + line * 3) % 103 = 0 then outlet_id + 10000000 else outlet_id end as outlet_id,
    year, month, distributor_id, sku_id, case when (order_key * 7 + line * 3) % 107 = 0 then 0.0::double else volume end as volume,
    case when (order_key * 7 + line * 3) % 109 = 0 then -bill else bill end as bill, order_key, line from tx
), outlet as (
  select c_custkey as outlet_id, c_mktsegment as outlet_type,
    case when c_acctbal < 1000 then 'Small' when c_acctbal < 4000 then 'Medium' when c_acctbal < 8000 then 'Large' else 'Extra Large' end as outlet_size, c_custkey % 5 as coolers from customer
), raw_outlet as (
  select case when outlet_id % 211 = 0 then null when outlet_id % 197 = 0 then outlet_id - 1 else outlet_id end as outlet_id,
    case when outlet_id % 11 = 0 then '  small ' when outlet_id % 13 = 0 then 'HUGE' when outlet_id % 17 = 0 then null else upper(outlet_size) end as outlet_size,
    case when outlet_id % 9 = 0 then ' MACHNERY ' when outlet_id % 19 = 0 then null else outlet_type end as outlet_type,
    case when outlet_id % 23 = 0 then 'NA' when outlet_id % 29 = 0 then '-2' when outlet_id % 31 = 0 then '2.7' else cast(coolers as varchar) end as coolers, outlet_id as row_no from outlet
), coord as (
  select c_custkey as outlet_id, case when c_custkey % 97 = 0 then 0.0::double else (68000 + (c_custkey * c_custkey * 31 + c_custkey * 7919) % 1999) / 10000.0::double end as lat,
    case when c_custkey % 97 = 0 then 0.0::double else (798000 + (c_custkey * c_custkey * c_custkey * 17 + c_custkey * 104729 + 13) % 1997) / 10000.0::double end as lon from customer
), ring as (
  select c_custkey as outlet_id, {RING_COLUMNS} from customer
), seller as (
  select distinct s_suppkey % 20 as n from supplier
), label as (
  select {DIST("n")} as distributor_id, cast(y as bigint) as year, cast(mo as bigint) as month,
    case when (n * 7 + y * 3 + mo * 5) % 37 = 0 then 'Unknown' else ({ARR(DOMAIN.labels)})[cast((n * 7 + y * 3 + mo * 5) % 3 + 1 as int)] end as label, n as row_no
  from seller, unnest({list(DOMAIN.years)}) as a(y), unnest({list(DOMAIN.months)}) as b(mo)
), hday as (
  select o_orderdate::date as date, date_diff('day', date '1990-01-01', o_orderdate::date) as k, case when k % 31 = 0 then 'day ' || k else strftime(o_orderdate::date, '%Y-%m-%d') end as day, 'Holiday ' || (k % 50) as name
  from (select distinct o_orderdate::date as o_orderdate from orders where o_orderdate is not null)
), holiday as (
  select day, name, ({ARR(KINDS)})[cast(k % 4 + 1 as int)] as kind, k * 3 as row_no from hday where k % 7 = 0
  union all select day, name, ({ARR(KINDS)})[cast((k + 1) % 4 + 1 as int)], k * 3 + 1 from hday where k % 7 = 3
  union all select day, name, ({ARR(KINDS)})[cast((k + 2) % 4 + 1 as int)], k * 3 + 1 from hday where k % 21 = 0
  union all select day, name, ({ARR(KINDS)})[cast(k % 4 + 1 as int)], k * 3 + 2 from hday where k % 35 = 0
), mode_m as (
  select outlet_id, year, month, distributor_id from (
    select outlet_id, year, month, distributor_id, row_number() over (partition by outlet_id, year, month order by count(*) desc, distributor_id) as rn from tx group by outlet_id, year, month, distributor_id) where rn = 1
), m as (
  select t.outlet_id, t.year, t.month, {SUM("t.volume")} as volume, {SUM("t.bill")} as bill, count(distinct sku_id) as n_skus, count(*) as n_tx, any_value(d.distributor_id) as distributor_id
  from tx t join mode_m d using (outlet_id, year, month) group by t.outlet_id, t.year, t.month
), place as (
  select outlet_id, distributor_id, {PROVINCE("distributor_id")} as province from (
    select outlet_id, distributor_id, row_number() over (partition by outlet_id order by count(*) desc, distributor_id) as rn from m group by outlet_id, distributor_id) where rn = 1
), stats as (
  select *, vol_std / greatest(vol_mean, 1e-9) as vol_cv, bill_mean / greatest(vol_mean, 1e-9) as price_avg from (
    select outlet_id, {AVG("volume")} as vol_mean, median(volume) as vol_median, max(volume) as vol_max, coalesce(stddev_samp(volume), 0) as vol_std,
      quantile_cont(volume, 0.75) as vol_p75, quantile_cont(volume, 0.95) as vol_p95, quantile_cont(volume, 0.99) as vol_p99, {AVG("bill")} as bill_mean, {SUM("volume")} as vol_total, cast(sum(n_tx) as bigint) as n_tx, avg(n_skus) as sku_mean, count(*) as n_months
    from m group by outlet_id)
), trend as (
  select outlet_id, coalesce(case when n = 6 and far > 0 then near / far end, 1.0) as recent_trend from (
    select outlet_id, count(*) as n, {SUM("case when rn <= 3 then volume end")} as near, {SUM("case when rn between 4 and 6 then volume end")} as far from (
      select *, row_number() over (partition by outlet_id order by year * 12 + month desc) as rn from m) where rn <= 6 group by outlet_id)
), growth as (
  select outlet_id, coalesce(case when prior > 0 then latest / prior end, 1.0) as yoy_growth from (
    select outlet_id, {AVG("case when year = 2000 then volume end")} as latest, {AVG("case when year = 1999 then volume end")} as prior from m group by outlet_id)
), cens as (
  select outlet_id, avg(case when volume >= 0.98 * vol_p95 then 1.0::double else 0.0::double end) as censoring_score from m join stats using (outlet_id) group by outlet_id
), flat as (
  select outlet_id, time_idx, n, case when prev >= p75 and volume >= p75 and abs(volume - prev) / greatest(prev, 1e-9) < 0.05 then 1 else 0 end as flat from (
    select m.outlet_id, year * 12 + month as time_idx, volume, vol_p75 as p75, lag(volume) over (partition by m.outlet_id order by year * 12 + month) as prev, count(*) over (partition by m.outlet_id) as n
    from m join stats using (outlet_id))
), plateau as (
  select outlet_id, cast(case when max(n) < 3 then 0 else max(length) end as bigint) as plateau_score from (
    select outlet_id, run, sum(flat) as length, max(n) as n from (
      select *, sum(1 - flat) over (partition by outlet_id order by time_idx) as run from flat) group by outlet_id, run) group by outlet_id
), txf as (
  select s.*, recent_trend, yoy_growth, censoring_score, plateau_score, plateau_score / greatest((select max(plateau_score) from plateau), 1)::double as plateau_norm
  from stats s join trend using (outlet_id) join growth using (outlet_id) join cens using (outlet_id) join plateau using (outlet_id)
), density as (
  select outlet_id, {" + ".join(f"{int(w)} * {t}_1000" for t, w in WEIGHTS.items())} as poi_density from ring
), ranked as (
  select o.*, p.distributor_id, p.province, coalesce(d.poi_density, 0) as poi_density, row_number() over (order by coalesce(d.poi_density, 0), o.outlet_id) as rn, count(*) over () as n
  from outlet o join place p using (outlet_id) left join density d using (outlet_id)
), member as (
  select outlet_id, outlet_type, outlet_size, coolers, distributor_id, province, poi_density, poi_tier, urban, province || '|' || outlet_type || '|' || poi_tier as cluster from (
    select *, 'q' || cast(case when n <= 1 then 1 else greatest(1, (4 * (rn - 1) + n - 2) // (n - 1)) end as varchar) as poi_tier,
      case when poi_density > (select median(poi_density) from ranked) then 1 else 0 end as urban from ranked)
), peer as (
  select t.outlet_id, t.cluster, t.vol_mean, count(*) over (partition by cluster) as cluster_size,
    (rank() over (partition by cluster order by vol_mean) + (count(*) over (partition by cluster, vol_mean) - 1) / 2.0::double) / count(*) over (partition by cluster) as peer_rank, peer_p85, peer_p99, greatest(peer_p85 - vol_mean, 0) as gap_to_p85
  from (select member.outlet_id, cluster, vol_mean from member join stats using (outlet_id)) t
  join (select cluster, quantile_cont(volume, 0.85) as peer_p85, quantile_cont(volume, 0.99) as peer_p99 from m join member using (outlet_id) group by cluster) q using (cluster)
), season as (
  select p.outlet_id, coalesce(l.label, 'Moderate') as season_label from place p left join (
    select distributor_id, arg_max(label, year) as label from label where month = 1 and label <> 'Unknown' group by distributor_id) l using (distributor_id)
), phys as (
  select outlet_id, raw as physical_raw, greatest(raw, {POTENTIAL.floor} * vol_max) as physical_max, greatest(raw - vol_max, 0) as cooler_headroom, case when vol_max > raw then 1 else 0 end as capacity_breached, least(vol_mean / raw, 5.0) as cooler_use
  from (select outlet_id, vol_max, vol_mean, case when coolers > 0 then coolers * {POTENTIAL.litres} * {POTENTIAL.turns} else {POTENTIAL.no_cooler} end::double as raw from member join stats using (outlet_id))
), pre as (
  select member.*, txf.* exclude (outlet_id), cluster_size, peer_p85, peer_p99, season_label, phys.* exclude (outlet_id), vol_p95 as stage_a,
    case season_label when 'Favorable' then 1.3 when 'Moderate' then 1.0 else 0.7 end::double as season,
    1 + 0.25::double * least(greatest(0.5::double * censoring_score + 0.5::double * plateau_norm, 0), 1) as uplift, {POTENTIAL.floor}::double * vol_max as floor,
    case when censoring_score > {POTENTIAL.supply_bound} then 'supply' else 'demand' end as constraint_type
  from member join txf using (outlet_id) join (select outlet_id, cluster_size, peer_p85, peer_p99 from peer) using (outlet_id) join season using (outlet_id) join phys using (outlet_id)
), diag as (
  select *, greatest(least(scaled, ceiling), floor) as potential,
    case when floor >= stage_a and floor >= peer_p85 then 'floor' when stage_a >= peer_p85 then 'model' else 'peer' end as winner
  from (select *, raw * season * uplift as scaled, case when capacity_breached = 1 then {POTENTIAL.ceiling} * peer_p99 else least({POTENTIAL.ceiling} * peer_p99, physical_max) end as ceiling
    from (select *, greatest(floor, stage_a, peer_p85) as raw from pre))
), cand as (
  select outlet_id, distributor_id, outlet_type, outlet_size, vol_mean as recent_actual, potential, greatest(potential - vol_mean, 0.0) as gap, constraint_type,
    case when constraint_type = 'supply' then {BUDGET.k_supply!r}::double else {BUDGET.k_demand!r}::double end as k,
    case when constraint_type = 'supply' and coolers <= 1 then 'cooler' when constraint_type = 'supply' then 'merchandising' else 'discount' end as spend_type
  from diag where province = '{BUDGET.province}'
), steps as (
  select outlet_id, j, row_number() over (order by gap * k * exp(-k * {BUDGET.step} * j) desc, outlet_id, j) as rn
  from cand, range({int(-(-BUDGET.cap // BUDGET.step))}) as r(j) where gap > 0
), greedy as (
  select c.outlet_id, coalesce(s.spend, 0.0) as spend from cand c left join (
    select outlet_id, sum(least({BUDGET.step}::double, {BUDGET.cap}::double - j * {BUDGET.step}::double)) as spend from steps where rn <= {int(BUDGET.total // BUDGET.step)} group by outlet_id) s using (outlet_id)
), brk as (
  select pt, sum(slope) as slope from (
    select ln(gap * k) as pt, 1 / k as slope from cand where gap > 0 union all select ln(gap * k) - k * {BUDGET.cap}, -1 / k from cand where gap > 0) group by pt
), run as (
  select pt, rate, coalesce(rate * (pt - lead(pt) over (order by pt desc)), 0.0) as gain from (select pt, sum(slope) over (order by pt desc) as rate from brk)
), cum as (
  select *, coalesce(sum(gain) over (order by pt desc rows between unbounded preceding and 1 preceding), 0.0) as used from run
), lvl as (
  select max(pt - ({BUDGET.total} - used) / rate) as level from cum where used <= {BUDGET.total} and used + gain >= {BUDGET.total} and rate > 1e-12
), water as (
  select outlet_id, case when gap > 0 then case when level is null then {BUDGET.cap}::double else greatest(0.0, least({BUDGET.cap}::double, (ln(gap * k) - level) / k)) end else 0.0 end as spend from cand, lvl
), alloc as (
  select cand.*, round_even(spend, 2) as spend, gap * (1 - exp(-k * spend)) as increment from cand join water using (outlet_id)
)
"""

TAGS = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in POI_TAGS)
