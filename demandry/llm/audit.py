"""How quality filters interact: what each removes in every order in which they may be applied."""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
SETS, ORDERS = 1 << len(FILTERS), factorial(len(FILTERS))
#: Fewest words; least distinct words and most capitals in a hundred.
WORDS, DISTINCT, CAPITALS = 200, 50, 3
SPACES, MARKS = r"[\x20\x09-\x0D]+", r"[#$%&*|]"
#: A document: its id, and 128 bits of its text.
KEY = ("doc_id", "x", "y")


def word_totals(texts: DataFrame) -> DataFrame:
    """(doc_id, x, y, words, different) of texts (doc_id, x, y, text): words are exploded, counted by document and word,
    then by document. A document without words has no row.

    Rows that repeat a document are dropped first; this deals documents by their key, so that neither count is shuffled.
    """
    words = texts.dropDuplicates([*KEY]).select(*KEY, F.explode(F.split("text", SPACES)).alias("word")).where("word != ''")
    each = words.groupBy(*KEY, "word").agg(F.count("*").alias("n"))
    return each.groupBy(*KEY).agg(F.sum("n").alias("words"), F.count("*").alias("different"))


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, x, y, part, fails, n): how many rows of each document are in a part, and the bits of A to D that they fail."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("x"), F.xxhash64(F.lit("text"), text).alias("y"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    capitals = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    marked = own.select(*KEY, "part", (100 * capitals > CAPITALS * F.length("text")).alias("c"), F.col("text").rlike(MARKS).alias("d"))
    rows = marked.groupBy(*KEY, "part", "c", "d").agg(F.count("*").alias("n"))
    of = word_totals(own.select(*KEY, "text")).select(*[F.col(k).alias(f"w_{k}") for k in KEY], "words", "different")
    same = F.col("doc_id").eqNullSafe(F.col("w_doc_id")) & (F.col("x") == F.col("w_x")) & (F.col("y") == F.col("w_y"))
    words, different = F.coalesce("words", F.lit(0)), F.coalesce("different", F.lit(0))
    bits = [words < WORDS, 100 * different < DISTINCT * words, F.col("c"), F.col("d")]
    fails = sum((F.when(bit, 1 << k).otherwise(0) for k, bit in enumerate(bits)), F.lit(0))
    return rows.join(of, same, "left").select(*KEY, "part", fails.alias("fails"), "n")


def outcomes(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, good, toxic, fails, n): rows by all filters that they fail, E included, and by labels of their documents.

    E passes at the smallest id of a text only (nulls are last, and all pass where a text has no other id). Rows of the
    same text are added up by part, labels and failures, with the smallest id of each and its rows: so that a text with
    many copies is a few rows when they meet.
    """
    rated = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(k) for c, k in (("quality", "good"), ("toxic", "toxic"))])
    known = found.join(rated, "doc_id", "left").fillna(0, ["good", "toxic"])
    grouped = known.groupBy("x", "y", "part", "good", "toxic", "fails").agg(F.sum("n").alias("n"), F.min("doc_id").alias("low"), F.min_by("n", "doc_id").alias("n_low"))
    least = F.min("low").over(Window.partitionBy("x", "y"))
    passing = F.when(F.col("least").isNull(), F.col("n")).when(F.col("low") == F.col("least"), F.col("n_low")).otherwise(F.lit(0))
    told = grouped.withColumn("least", least).withColumn("passing", passing)
    both = F.array(F.struct(F.col("fails").alias("fails"), F.col("passing").alias("n")), F.struct(F.col("fails").bitwiseOR(SETS // 2).alias("fails"), (F.col("n") - F.col("passing")).alias("n")))
    return told.select("part", "good", "toxic", F.explode(both).alias("o")).select("part", "good", "toxic", "o.fails", "o.n")


def tallies(found: DataFrame) -> DataFrame:
    """One row for each part: counts of rows by the set of filters that they fail (32 columns, gathered in an array), of
    all rows, of good and of toxic ones."""
    weight = {"every": F.col("n"), "good": F.col("n") * F.col("good"), "toxic": F.col("n") * F.col("toxic")}
    sums = [F.sum(F.when(F.col("fails") == s, w).otherwise(0)).alias(f"{k}_{s}") for k, w in weight.items() for s in range(SETS)]
    return found.groupBy("part").agg(*sums).select("part", *[F.array(*[f"{k}_{s}" for s in range(SETS)]).alias(k) for k in weight])


def _total(counts: str, where: Callable[[Column], Column], share: Callable[[Column], Column] = lambda s: F.lit(1)) -> Column:
    """The sum over the sets (numbered by their bits) that meet a condition."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(SETS - 1)), F.lit(0).cast("long"), lambda total, s: total + F.when(where(s), F.element_at(counts, s + 1) * share(s)).otherwise(0))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """A row for each part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost and shapley.

    A null text is empty (it fails A); a null part is the empty string; repeated rows count as rows of their own, and do
    not make each other fail E, which asks for a smaller id; of null ids see `outcomes`. A document labelled more than
    once has a label if a row of it has. An empty table has no part and so no rows. Other columns aren't read.
    """
    counts = tallies(outcomes(failures(docs, id_col, text_col, part_col), labels))
    ordered = counts.withColumn("filter_order", F.explode(F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])))
    steps = ordered.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = F.element_at(F.array(*[F.lit(1 << k) for k in range(len(FILTERS))]), F.instr(F.lit(FILTERS), F.substring(F.col("filter_order"), F.col("step"), F.lit(1))))
    letters = F.split(F.substring(F.col("filter_order"), F.lit(1), F.col("step") - 1), "")
    before = F.aggregate(letters, F.lit(0), lambda mask, x: mask + F.when(x != "", F.pow(F.lit(2), F.instr(F.lit(FILTERS), x) - 1).cast("int")).otherwise(0))
    own = steps.withColumn("bit", bit).withColumn("before", before)
    fails, earlier = (lambda s: s.bitwiseAND(F.col("bit")) != 0), (lambda s: s.bitwiseAND(F.col("before")) != 0)
    removed = lambda s: fails(s) & ~earlier(s)
    return own.select(
        "part", "filter_order", "step",
        _total("every", lambda s: ~fails(s) & ~earlier(s)).alias("kept"),
        _total("every", removed).alias("removed"),
        _total("every", lambda s: fails(s) & earlier(s)).alias("redundant"),
        _total("every", lambda s: s == F.col("bit")).alias("unique_fails"),
        _total("good", removed).alias("good_lost"),
        _total("toxic", removed).alias("toxic_lost"),
        # Of the orders, a filter comes first among the m that a row fails in one of m.
        _total("every", fails, lambda s: (ORDERS / F.bit_count(s)).cast("long")).alias("shapley"),
    )


def op13_filters(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP13_SQL = rf"""
WITH own AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
firsts AS (SELECT text, min(doc_id) AS least FROM own GROUP BY text),
rated AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(words) < {WORDS})::INT + 2 * (100 * len(list_distinct(words)) < {DISTINCT} * len(words))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > {CAPITALS} * length(text))::INT
    + 8 * regexp_matches(text, '{MARKS}')::INT + 16 * coalesce(own.doc_id > least OR (own.doc_id IS NULL AND least IS NOT NULL), false)::INT AS fails
  FROM own JOIN firsts USING (text) LEFT JOIN rated ON rated.doc_id = own.doc_id
),
bits AS (SELECT substr('{FILTERS}', k + 1, 1) AS f, (1 << k) AS bit FROM range({len(FILTERS)}) t(k)),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM bits a, bits b, bits c, bits d, bits e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = {SETS - 1} AND (a.bit | b.bit | c.bit | d.bit | e.bit) = {SETS - 1}
),
steps AS (
  SELECT filter_order, k AS step, bit, coalesce((SELECT sum(o.bit) FROM bits o WHERE contains(substr(filter_order, 1, k - 1), o.f)), 0)::INT AS earlier
  FROM orders, range(1, {len(FILTERS) + 1}) t(k), bits WHERE bits.f = substr(filter_order, k, 1)
),
tally AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, fails),
told AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN fails & (bit | earlier) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN fails & bit <> 0 AND fails & earlier = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN fails & bit <> 0 AND fails & earlier <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN fails = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN fails & bit <> 0 AND fails & earlier = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN fails & bit <> 0 AND fails & earlier = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM tally, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM told
"""
