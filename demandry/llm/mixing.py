"""Mixing sources to target weights by Efraimidis-Spirakis sampling in whole epochs and a fraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WORD, materialise

#: Weights of the sources by their order, repeating; times of its own size that a source is taken at most.
WEIGHTS, MOST = (5, 2, 1), 3
#: Weight of a document by its quality label: 0, 1, or none.
QUALITY = {0: 1.0, 1: 4.0, None: 2.0}
#: Bins of the sampling key within a source; only the bin at the cut is sorted.
BINS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(quality: Column) -> Column:
    return F.when(quality == 0, QUALITY[0]).when(quality == 1, QUALITY[1]).otherwise(QUALITY[None])


def sampling_key(seed: str, *by: Column) -> Column:
    """-ln(u): an exponential variate that depends on the given columns only."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *by)), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(1 << 52))


def source_targets(sizes: DataFrame, source_col: str) -> DataFrame:
    """(source, source_size, target) of (source, source_size): shares by weight, none above MOST times its size.

    Sorted by cap per unit of weight, the capped sources come first; what they leave is shared by weight by the rest.
    The windows run over the sources' sums, one row for each.
    """
    cap = F.col("source_size") * MOST
    order = F.row_number().over(Window.orderBy(F.col(source_col).asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(order, F.lit(len(WEIGHTS))) + 1).cast("int"))
    all_ = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col(source_col).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("cap", cap).withColumn("weight", weight)
    ranked = ranked.withColumn("left_size", F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("left_weight", F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    level = F.col("left_size") / F.col("left_weight")
    ranked = ranked.withColumn("capped", level > F.col("cap") / F.col("weight"))
    rest = F.min(F.when(~F.col("capped"), F.struct((F.col("cap") / F.col("weight")).alias("by"), F.col(source_col).isNull().alias("last"), F.col(source_col).alias("name"), level.alias("level")))).over(all_)["level"]
    return ranked.select(source_col, "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(rest * F.col("weight")).alias("target"))


def mix(docs: DataFrame, size: Column, weight: Column, id_col: str = "doc_id", source_col: str = "source", seed: str = "mix", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with size, source_size, target (of its source) and taken, the words that the mix takes of the document.

    Each source is taken in whole epochs as often as its target holds its size; the rest of the budget is filled in the
    order of exponential keys divided by the weights, and the document at the cut gives its first words up to the
    budget. So each source takes its target, rounded to a word. Null or non-positive weights count as 1, null sizes as
    0; a null source is a source; repeated rows are documents of their own (equal ones are interchangeable); an empty
    table gives none. Columns of docs pass through, whatever their names, but the four named here are replaced.

    Keys are binned within a source: sums of the bins tell which bin holds the cut, and only its documents are sorted,
    so that no task sorts a whole source.
    """
    names = ["size", "source_size", "target", "taken"]
    kept = [c for c in docs.columns if c not in names]
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(size, F.lit(0)).cast("long").alias("size"), F.when(weight > 0, weight).otherwise(F.lit(1.0)).alias("weight"))
    own = own.withColumn("key", sampling_key(seed, F.col("id").cast("string"), F.col("size").cast("string")) / F.col("weight")).drop("weight")
    own = materialise(own.withColumn("bin", F.least(F.floor((1 - F.exp(-2 * F.col("key"))) * BINS), F.lit(BINS - 1)).cast("int")), "mix")
    bins = own.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")).checkpoint()
    targets = source_targets(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")), "source")
    budget = F.round("target").cast("long")
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    targets = targets.withColumn("rest", budget - F.col("epochs") * F.col("source_size")).withColumnRenamed("source", "of").checkpoint()
    upto = F.sum("bin_size").over(Window.partitionBy("source").orderBy("bin"))
    cut = bins.withColumn("upto", upto).join(targets, F.col("source").eqNullSafe(F.col("of")))
    cut = cut.where((F.col("rest") > 0) & (F.col("upto") >= F.col("rest"))).groupBy(F.col("of").alias("at")).agg(F.min(F.struct("bin", (F.col("upto") - F.col("bin_size")).alias("before"))).alias("cut"))
    plan = targets.join(cut, F.col("of").eqNullSafe(F.col("at")), "left").drop("at").checkpoint()
    if plan.count() <= broadcast_rows:
        plan = F.broadcast(plan)
    own = own.join(plan, F.col("source").eqNullSafe(F.col("of")))
    at_cut = F.coalesce(F.col("bin") == F.col("cut.bin"), F.lit(False))
    rows = Window.partitionBy("source").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    sorted_ = own.where(at_cut).withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("cut.before") - F.sum("size").over(rows) + F.col("size"))))
    others = own.where(~at_cut).withColumn("part", F.when(F.col("bin") < F.col("cut.bin"), F.col("size")).otherwise(F.lit(0)))
    taken = (F.col("epochs") * F.col("size") + F.col("part")).cast("long")
    return others.unionByName(sorted_).select(*[F.col("row")[c].alias(c) for c in kept], "size", F.col("source_size").cast("long").alias("source_size"), "target", taken.alias("taken"))


def with_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with quality, the largest label of its doc_id or null; a label table with repeated ids adds no rows."""
    best = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__label")).agg(F.max("quality").alias("quality"))
    return docs.drop("quality").join(best, F.col("doc_id") == F.col("__label"), "left").drop("__label")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    sized = with_quality(docs.select("doc_id", "source", word_count(F.col("text")).alias("words")), labels)
    return mix(sized, F.col("words"), quality_weight(F.col("quality"))).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = f"""
with best as (
  select doc_id, max(quality) as quality from labels where doc_id is not null group by doc_id
), doc as (
  select row_number() over () as rid, d.doc_id, d.source,
    cast(coalesce(len(regexp_extract_all(d.text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as size,
    case b.quality when 0 then {QUALITY[0]} when 1 then {QUALITY[1]} else {QUALITY[None]} end as weight
  from documents d left join best b on d.doc_id = b.doc_id
), keyed as (
  select *, -ln((cast(cast('0x' || substr(md5(concat_ws(':', 'mix', cast(doc_id as varchar), cast(size as varchar))), 1, 13) as bigint) as double) + 0.5)
    / 4503599627370496.0) / weight as k from doc
), src as (
  select source, cast(sum(size) as double) as source_size from doc group by source
), weighed as (
  select *, {MOST} * source_size as cap,
    cast(case (row_number() over (order by source nulls last) - 1) % 3 when 0 then {WEIGHTS[0]} when 1 then {WEIGHTS[1]} else {WEIGHTS[2]} end as double) as w
  from src
), ranked as (
  select *, sum(source_size) over () - coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as left_size,
    sum(w) over () - coalesce(sum(w) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as left_weight
  from weighed
), flagged as (
  select *, left_size / left_weight > cap / w as capped from ranked
), level as (
  select left_size / left_weight as level from flagged where not capped order by cap / w, source nulls last limit 1
), targets as (
  select source, source_size, case when capped then cap else level * w end as target from flagged, level
), budget as (
  select *, case when source_size > 0 then floor(round(target) / source_size) else 0 end as epochs from targets
), summed as (
  select d.*, b.source_size, b.target, b.epochs, round(b.target) - b.epochs * b.source_size as rest,
    sum(d.size) over (partition by d.source order by d.k, d.doc_id, d.size, d.rid rows unbounded preceding) as upto
  from keyed d join budget b on d.source is not distinct from b.source
)
select doc_id, size, cast(source_size as bigint) as source_size, target,
  cast(epochs * size + greatest(0, least(size, rest - (upto - size))) as bigint) as taken
from summed
"""
