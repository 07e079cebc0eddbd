"""A corpus pipeline of five stages over the documents table: language, lines, near-duplicates, benchmarks, mixture.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; ``run`` writes each result as Parquet to the
shared folder and reads it again for the next stage. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandry.llm.common import materialise, small
from demandry.llm.langid import UND, identify, remainder
from demandry.llm.lines import drop_boilerplate
from demandry.llm.mixing import mix, quality_weight, with_quality, word_count
from demandry.llm.simhash import simhash_groups
from demandry.llm.suffix import contaminated, decontaminate

#: A document whose language is less probably right than wrong is rejected.
SURE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without a letter go, and those whose language is less probably right than
    wrong, by a curve that is calibrated on held-back documents and doesn't depend on the number of languages. An empty
    table gives none; repeated rows stay; without a labelled document all go."""
    learn = F.coalesce(remainder("doc_id", 4) != 2, F.lit(False))
    found = identify(docs, learn)
    return found.where((F.col("lang_pred") != UND) & (F.col("score") >= SURE)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines; n_chars follows the text. A document of which every line
    would go is a copy of others and is left whole to the next stage, which keeps one of them. Ties don't arise; repeated
    rows count as pages of their own."""
    cut = drop_boilerplate(docs, keep_whole=True)
    return cut.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def row_key(columns: list[str]) -> Column:
    """128 bits that name a row by all its columns, nulls told from empty values: rows are taken for equal where it is."""
    own = [F.col(f"`{c}`") for c in columns]
    return F.struct(F.xxhash64(*own).alias("a"), F.xxhash64(F.lit("row"), *[c.isNull() for c in own], *own).alias("b"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the least key; of repeated rows one.

    Only rows that are to go, or repeat, are joined to the documents, by broadcast if they are counted to be few.
    """
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key(docs.columns).alias("key"))
    groups = materialise(simhash_groups(keyed.select(F.col("row.text").alias("text"), "key"), "key"), "groups")
    repeated = groups.where("key = component_id").groupBy("key").count().where("count > 1").select("key")
    bad = groups.where("key != component_id").select("key").distinct().unionByName(repeated).checkpoint()
    repeated = repeated.checkpoint()
    many = bad.count()
    once = keyed.join(small(bad, many), "key", "left_anti")
    one_of = keyed.join(small(repeated, many), "key", "left_semi").dropDuplicates(["key"])
    return once.unionByName(one_of).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark; repeated rows go or stay together."""
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key(docs.columns).alias("key"))
    found = decontaminate(keyed.select("key", F.col("row.text").alias("text")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "key")
    bad = found.where(contaminated(F.col("n_hit"), F.col("n_words"))).select("key").distinct().checkpoint()
    return keyed.join(small(bad, bad.count()), "key", "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target and taken (words), weighed by their quality labels;
    columns of documents with these names are replaced.

    Labels are joined to narrow rows without the texts, and the mix is of these rows. Those that it takes are then joined
    to the texts: always by a merge join, so that every size of input goes the same way. Repeated rows may be taken
    differently: theirs are counted by what is taken, one text of each is kept, and it is repeated by these counts.
    """
    names = ["size", "source_size", "target", "taken"]
    kept = [c for c in docs.columns if c not in names]
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), row_key(kept).alias("key"))
    narrow = materialise(keyed.select("key", F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), word_count(F.col("row.text")).alias("words")), "words")
    rated = with_quality(narrow, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    mixed = materialise(mix(rated, F.col("words"), quality_weight(F.col("quality"))).where("taken > 0").select("key", *names), "taken")
    repeated = narrow.groupBy("key").count().where("count > 1").select("key").checkpoint()
    many = repeated.count()
    out = [*[F.col("row")[c].alias(c) for c in kept], *names]
    once = keyed.join(mixed.join(small(repeated, many), "key", "left_anti").hint("merge"), "key").select(*out)
    if not many:
        return once
    counted = mixed.join(small(repeated, many), "key", "left_semi").groupBy("key", *names).agg(F.count("*").alias("copies"))
    one_of = keyed.join(small(repeated, many), "key", "left_semi").dropDuplicates(["key"])
    copies = one_of.join(counted, "key").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return once.unionByName(copies.select(*out))


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("benchmarks", benchmarks),
    ("mixture", mixture),
]
#: SQL can't express the stages; tests/llm compares them with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
