"""Checks of the finished tables as rows (check, observed, expected, status), and the exit code they amount to."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandry.config import BUDGET, POTENTIAL


#: The columns of the tables handed over, in their order.
PREDICTION_COLUMNS = ("outlet_id", "max_monthly_litres")
BUDGET_COLUMNS = ("outlet_id", "spend")


def _row(name: str, observed, expected, good, bad: str = "FAIL"):
    return F.struct(F.lit(name).alias("check"), observed.cast("double").alias("observed"), expected.cast("double").alias("expected"), F.when(good, "PASS").otherwise(bad).alias("status"))


def _columns(name: str, found: Sequence[str], wanted: Sequence[str]):
    """Columns in the order wanted; observed is how many of them stand in their place."""
    placed = sum(a == b for a, b in zip(found, wanted, strict=False))
    return _row(name, F.lit(placed), F.lit(len(wanted)), F.lit(list(found) == list(wanted)))


def _table(one: DataFrame, *rows) -> DataFrame:
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def predictions(diagnostic: DataFrame, expected_rows: DataFrame, handed: Sequence[str] = PREDICTION_COLUMNS, imputed: DataFrame | None = None) -> DataFrame:
    """Rows, columns of the hand-over, nulls, positivity, floor, and the order of segments. imputed (outlet_id, imputed 0/1)
    tells whose places were guessed: their share says how far the order of town and country can be trusted."""
    if imputed is None:
        imputed = diagnostic.select("outlet_id", F.lit(0).alias("imputed"))
    diagnostic = diagnostic.drop("imputed").join(imputed.select("outlet_id", "imputed"), "outlet_id", "left")
    x = F.col("potential")
    mean = lambda cond: F.coalesce(F.avg(F.when(cond, x)), F.lit(0.0))
    one = diagnostic.agg(
        F.count("*").alias("n"), F.count_if(x.isNull()).alias("nulls"), F.count_if(x <= 0).alias("low"), F.count_if(x < POTENTIAL.floor * F.col("vol_max") - 1e-6).alias("under"),
        mean(F.col("urban") == 1).alias("urban"), mean(F.col("urban") == 0).alias("rural"), mean(F.col("outlet_size").isin("Large", "Extra Large")).alias("large"), mean(F.col("outlet_size") == "Small").alias("small"), (100 * F.avg(F.coalesce("imputed", F.lit(1)).cast("double"))).alias("guessed"),
    ).crossJoin(F.broadcast(expected_rows.agg(F.count_distinct("outlet_id").alias("outlets"))))  # one row each
    zero = F.lit(0)
    return _table(
        one,
        _row("V01 rows", F.col("n"), F.col("outlets"), F.col("n") == F.col("outlets")),
        _columns("V02 columns", handed, PREDICTION_COLUMNS),
        _row("V03 nulls", F.col("nulls"), zero, F.col("nulls") == 0),
        _row("V04 not positive", F.col("low"), zero, F.col("low") == 0),
        _row("V05 below floor", F.col("under"), zero, F.col("under") == 0),
        _row("V07 urban over rural", F.round("urban", 4), F.round("rural", 4), F.col("urban") > F.col("rural"), "WARN"),
        _row("V07 places imputed in percent", F.round("guessed", 4), zero, F.col("guessed") == 0, "WARN"),
        _row("V08 large over small", F.round("large", 4), F.round("small", 4), F.col("large") > F.col("small")),
    )


def budget(allocated: DataFrame, diagnostic: DataFrame, handed: Sequence[str] = BUDGET_COLUMNS) -> DataFrame:
    """Columns of the hand-over, province, total, sign, and the number of funded outlets."""
    outside = allocated.join(diagnostic.where(F.col("province") == BUDGET.province).select("outlet_id"), "outlet_id", "left_anti").agg(F.count("*").alias("outside"))
    one = allocated.agg(F.round(F.sum("spend"), 2).alias("spent"), F.count_if(F.col("spend").isNull() | (F.col("spend") < 0)).alias("bad"), F.count_if(F.col("spend") > 1).alias("funded")).crossJoin(F.broadcast(outside))  # one row each
    zero = F.lit(0)
    return _table(
        one,
        _columns("B1 columns", handed, BUDGET_COLUMNS),
        _row("B2 outside province", F.col("outside"), zero, F.col("outside") == 0),
        _row("B3 within budget", F.col("spent"), F.lit(BUDGET.total), F.col("spent") <= BUDGET.total + 1),
        _row("B4 negative or null", F.col("bad"), zero, F.col("bad") == 0),
        _row("B5 funded", F.col("funded"), zero, F.col("funded") > 0, "WARN"),
    )


def explanations(texts: DataFrame, expected: DataFrame) -> DataFrame:
    """Coverage, texts that are empty or without evidence, the split by source, and texts with a number that isn't grounded.

    texts has outlet_id, explanation, packet, source and ungrounded.
    """
    missing = expected.join(texts.select("outlet_id"), "outlet_id", "left_anti").agg(F.count("*").alias("missing"))
    one = texts.agg(F.count_if((F.coalesce(F.length("explanation"), F.lit(0)) == 0) | F.col("packet").isNull()).alias("empty"), F.count_if(F.col("source") == "live").alias("live"), F.count("*").alias("n"), F.count_if(F.size("ungrounded") > 0).alias("loose")).crossJoin(F.broadcast(missing))  # one row each
    zero = F.lit(0)
    return _table(
        one,
        _row("X1 missing", F.col("missing"), zero, F.col("missing") == 0),
        _row("X2 empty", F.col("empty"), zero, F.col("empty") == 0),
        _row("X3 live texts", F.col("live"), F.col("n"), F.lit(True)),
        _row("X4 ungrounded", F.col("loose"), zero, F.col("loose") == 0),
    )


def guards(table: DataFrame, expected: DataFrame, key: str, required: Sequence[str]) -> DataFrame:
    """What must hold before a table is used: as many rows as expected, one for each key, each expected key, no nulls.

    Nulls in required columns are a warning, the rest fail. A null key counts as a missing one.
    """
    keys = expected.select(key).distinct()
    missing = keys.join(table.select(key), key, "left_anti").agg(F.count("*").alias("missing"))
    rows = expected.agg(F.count("*").alias("rows"))
    nulls = [F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in required]
    one = table.agg(F.count("*").alias("n"), F.count_distinct(key).alias("keys"), *nulls).crossJoin(F.broadcast(rows)).crossJoin(F.broadcast(missing))  # one row each
    zero = F.lit(0)
    return _table(
        one,
        _row("G1 rows", F.col("n"), F.col("rows"), F.col("n") == F.col("rows")),
        _row("G2 unique key", F.col("keys"), F.col("n"), F.col("keys") == F.col("n")),
        _row("G3 keys missing", F.col("missing"), zero, F.col("missing") == 0),
        *[_row(f"G4 nulls in {c}", F.col(f"nulls_{c}"), zero, F.col(f"nulls_{c}") == 0, "WARN") for c in required],
    )


def all_checks(*tables: DataFrame | None) -> DataFrame:
    """The checks of all tables that are there."""
    return reduce(lambda a, b: a.unionByName(b), [t for t in tables if t is not None])


def exit_code(checks: DataFrame) -> int:
    return int(checks.where("status = 'FAIL'").limit(1).count() > 0)
