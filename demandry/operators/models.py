"""Models of demand: boosted trees with folds of outlets, and tree attributions."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandry.functions.exprs import exact_avg
from demandry.operators.ranks import mean_ranks, running
from demandry.session import cut


def shares(loads: list[int], size: int, groups: int) -> list[int]:
    """How many of some equal groups go to each fold, if one after the other goes to the fold that has the least rows
    (of equal ones the first)."""
    taken = lambda level: [max(0, -(-(level - load) // size)) for load in loads]
    low, high = min(loads), max(loads) + size * groups + 1
    while high - low > 1:  # the highest level below which no more than the groups are taken
        level = (low + high) // 2
        low, high = (level, high) if sum(taken(level)) <= groups else (low, level)
    out = taken(low)
    for k in range(len(loads)):
        if sum(out) < groups and loads[k] + size * out[k] == low:
            out[k] += 1
    return out


def balanced_folds(panel: DataFrame, key: str, folds: int = 5) -> DataFrame:
    """(key, n_rows, fold): all rows of a key in one fold, the largest keys dealt first, each to the fold with the least
    rows so far.

    Only the number of keys of each size reaches the driver, where sizes are dealt; keys of one size are taken in the
    order of a hash, and their place among them, by ranges, tells the fold. A null key is a key.
    """
    return dealt(panel.groupBy(key).agg(F.count("*").alias("n_rows")), key, folds)


def dealt(sizes: DataFrame, key: str, folds: int) -> DataFrame:
    """`balanced_folds` of keys (key, n_rows) that are counted already."""
    sizes = cut(sizes)
    loads, rules = [0] * folds, []
    for size, groups in sizes.groupBy("n_rows").agg(F.count("*")).orderBy(F.desc("n_rows")).collect():  # a row for each size
        counts = shares(loads, size, groups)
        rules.append((size, [sum(counts[: k + 1]) for k in range(folds)]))
        loads = [load + size * n for load, n in zip(loads, counts, strict=True)]
    rule = sizes.sparkSession.createDataFrame(rules, "of_size long, upto array<long>")
    name = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    placed = running(sizes.withColumn("name", name), [F.col("name").asc(), F.col(key).asc()], ["n_rows"], before=F.lit(1))
    fold = F.size(F.filter("upto", lambda u: u <= F.col("before"))).cast("int")
    return placed.join(F.broadcast(rule), F.col("n_rows") == F.col("of_size")).select(key, "n_rows", fold.alias("fold"))  # sizes


def training_panel(months: DataFrame, features: DataFrame, first_year: int, share: float = 0.95) -> DataFrame:
    """Months below 95 % of their outlet's P99 with its features, year_norm, month_1..12 and the target log1p(volume).

    A null comparison keeps the row.
    """
    p99 = months.groupBy("outlet_id").agg(F.percentile("volume", F.lit(0.99)).alias("p99"))
    kept = months.join(p99, "outlet_id").where(~F.coalesce(F.col("volume") >= share * F.col("p99"), F.lit(False)))
    hot = [(F.col("month") == m).cast("int").alias(f"month_{m}") for m in range(1, 13)]
    return kept.join(features, "outlet_id", "left").select("outlet_id", "year", "month", *[c for c in features.columns if c != "outlet_id"], (F.col("year") - first_year).alias("year_norm"), *hot, F.log1p("volume").alias("target"))


def folded_months(profile: DataFrame, features: DataFrame, names: Sequence[str], first_year: int, share: float = 0.95, folds: int = 5) -> DataFrame:
    """(features, target, fold): `training_panel`, assembled, with `balanced_folds`, of a profile with months.

    Outlets meet their features and are dealt to folds before their months are taken apart, so that no table of months is
    shuffled; their parts are not merged by size, as they grow by it.
    """
    n = int(profile.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = profile.select("outlet_id", F.filter("months", lambda m: ~F.coalesce(m["volume"] >= share * F.col("vol_p99"), F.lit(False))).alias("months")).where(F.size("months") > 0)
    fold = dealt(kept.select("outlet_id", F.size("months").cast("long").alias("n_rows")), "outlet_id", folds).select("outlet_id", "fold")
    one = kept.repartition(n, "outlet_id").join(fold.hint("merge"), "outlet_id").join(features.hint("merge"), "outlet_id", "left")
    rows = one.select("fold", *[c for c in features.columns if c != "outlet_id"], F.explode("months").alias("m")).select("*", "m.*")
    hot = {f"month_{k}": (F.col("month") == k).cast("int") for k in range(1, 13)}
    return assemble(rows.withColumns({"year_norm": F.col("year") - first_year, "target": F.log1p("volume"), **hot}), names).select("features", "target", "fold")


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(filled)


#: Least rows of a leaf, and the shares of rows and of features that a tree sees.
LEAF, ROWS, COLUMNS = 200, 0.8, 0.8
#: Rounds without gain after which no more are fitted, and how many are fitted at first.
PATIENCE, FIRST = 50, 100


def trees(rounds: int, rate: float, depth: int, seed: int, leaf: int = LEAF) -> GBTRegressor:
    return GBTRegressor(featuresCol="features", labelCol="target", maxIter=rounds, stepSize=rate, maxDepth=depth, minInstancesPerNode=leaf, subsamplingRate=ROWS, featureSubsetStrategy=str(COLUMNS), seed=seed)


def stopping_round(errors: Sequence[float], patience: int = PATIENCE) -> tuple[int, bool]:
    """(best round, whether `patience` rounds without gain follow it), of the errors of rounds 1, 2, ..."""
    best = 0
    for k, error in enumerate(errors):
        if error < errors[best]:
            best = k
        elif k - best >= patience:
            return best + 1, True
    return best + 1, False


def early_stopped(train: DataFrame, valid: DataFrame, rounds: int, rate: float, depth: int, seed: int, leaf: int = LEAF, patience: int = PATIENCE, first: int = FIRST) -> tuple[int, float, int]:
    """(best round, error there, rounds fitted): trees are fitted until `patience` rounds bring no gain on valid.

    Rounds are doubled from `first`, as trees of the same seed begin alike: at most twice as many are fitted as it takes
    to stop, and never more than `rounds`.
    """
    fitted = min(first, rounds)
    while True:
        errors = trees(fitted, rate, depth, seed, leaf).fit(train).evaluateEachIteration(valid, "squared")
        best, stopped = stopping_round(errors, patience)
        if stopped or fitted >= rounds:
            return best, float(math.sqrt(errors[best - 1])), fitted
        fitted = min(2 * fitted, rounds)


def cross_validate(panel: DataFrame, features: Sequence[str], rounds: int = 2000, rate: float = 0.05, depth: int = 6, folds: int = 5, seed: int = 42, leaf: int = LEAF) -> DataFrame:
    """(fold, n_train, n_valid, best_round, rmse, fitted) of each fold: trees fitted on the other folds' outlets.

    Folds have all rows of an outlet and are balanced by rows. best_round is the one of the least error on the fold, up to
    PATIENCE rounds without gain; rmse the error there, of log1p(volume). Spark's trees grow level by level; a depth of 6
    has as many leaves (64) as a leaf-wise tree of 63.
    """
    dealt = balanced_folds(panel, "outlet_id", folds)
    joined = assemble(panel, features).join(dealt.select(F.col("outlet_id").alias("of"), "fold"), F.col("outlet_id").eqNullSafe(F.col("of")))
    return cross_validate_folds(cut(joined.select("features", "target", "fold")), rounds, rate, depth, folds, seed, leaf)


def cross_validate_folds(data: DataFrame, rounds: int = 2000, rate: float = 0.05, depth: int = 6, folds: int = 5, seed: int = 42, leaf: int = LEAF) -> DataFrame:
    """`cross_validate` of assembled rows (features, target, fold), which every fold reads."""
    sizes, rows = {r[0]: r[1] for r in data.groupBy("fold").count().collect()}, []
    whole = sum(sizes.values())
    for fold in range(folds):
        n = [whole - sizes.get(fold, 0), sizes.get(fold, 0)]
        if all(n):
            best, error, fitted = early_stopped(data.where(F.col("fold") != fold), data.where(F.col("fold") == fold), rounds, rate, depth, seed, leaf)
            rows.append((fold, *n, best, error, fitted))
    return data.sparkSession.createDataFrame(rows, "fold int, n_train long, n_valid long, best_round int, rmse double, fitted int")


def cv_metrics(folds: DataFrame) -> DataFrame:
    """One row of the folds' metrics: their number, mean and standard deviation of the RMSE, and the mean best round."""
    return folds.agg(F.count("*").alias("folds"), F.avg("rmse").alias("rmse_mean"), F.coalesce(F.stddev_pop("rmse"), F.lit(0.0)).alias("rmse_std"), F.floor(F.avg("best_round")).cast("int").alias("rounds"))


def fit_trees(panel: DataFrame, features: Sequence[str], rounds: int, rate: float = 0.05, depth: int = 6, seed: int = 42, leaf: int = LEAF) -> GBTRegressionModel:
    """Boosted trees on the whole panel (or on what is assembled of it), with the rounds that cross-validation gave."""
    return trees(rounds, rate, depth, seed, leaf).fit(panel if "features" in panel.columns else assemble(panel, features))


def save_trees(model: GBTRegressionModel, features: Sequence[str], path: str, spark) -> None:
    """The model and its features' names, in a folder that load_trees reads; an older one is replaced."""
    model.write().overwrite().save(f"{path}/trees")
    spark.createDataFrame([(k, f) for k, f in enumerate(features)], "place int, feature string").coalesce(1).write.mode("overwrite").parquet(f"{path}/features")


def load_trees(path: str, spark) -> tuple[GBTRegressionModel, list[str]]:
    return GBTRegressionModel.load(f"{path}/trees"), [r.feature for r in spark.read.parquet(f"{path}/features").orderBy("place").collect()]


def importance(model: GBTRegressionModel, features: Sequence[str], spark) -> DataFrame:
    """(feature, gain, splits): each feature's share of the gain, and how many splits of all trees are on it."""
    splits = Counter(f for _, nodes in _tree_arrays(model) for f in nodes["feature"] if f >= 0)
    rows = [(f, float(v), splits[k]) for k, (f, v) in enumerate(zip(features, model.featureImportances.toArray(), strict=True))]
    return spark.createDataFrame(rows, "feature string, gain double, splits int").orderBy(F.desc("gain"), "feature")


def _tree_arrays(model: GBTRegressionModel) -> list[tuple[float, dict]]:
    """(weight, nodes) of each tree, read from the model's Java nodes: bounded by depth and rounds."""
    out = []
    for weight, tree in zip(model.treeWeights, model.trees, strict=True):
        nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value", "cover")}

        def visit(node, nodes=nodes) -> int:
            at = len(nodes["value"])
            leaf = node.subtreeDepth() == 0
            split = None if leaf else node.split()
            for k, v in (("feature", -1 if leaf else split.featureIndex()), ("threshold", 0.0 if leaf else split.threshold()), ("left", -1), ("right", -1), ("value", node.prediction()), ("cover", float(node.impurityStats().count()))):
                nodes[k].append(v)
            if not leaf:
                nodes["left"][at] = visit(node.leftChild())
                nodes["right"][at] = visit(node.rightChild())
            return at

        visit(tree._java_obj.rootNode())
        out.append((float(weight), nodes))
    return out


def _leaf_paths(nodes: dict) -> list[tuple[float, list[tuple[int, float, float, float]]]]:
    """For each leaf its value and, per feature on the way, (feature, lower, upper, share of rows that the splits let by)."""
    paths = []

    def visit(at: int, met: dict) -> None:
        f = nodes["feature"][at]
        if f < 0:
            paths.append((nodes["value"][at], [(k, *v) for k, v in met.items()]))
            return
        for child, low, high in ((nodes["left"][at], -math.inf, nodes["threshold"][at]), (nodes["right"][at], nodes["threshold"][at], math.inf)):
            a, b, share = met.get(f, (-math.inf, math.inf, 1.0))
            part = nodes["cover"][child] / max(nodes["cover"][at], 1e-12)
            visit(child, {**met, f: (max(a, low), min(b, high), share * part)})

    visit(0, {})
    return paths


def attributions(df: DataFrame, model: GBTRegressionModel, features: Sequence[str], keep: Sequence[str] = ("outlet_id",)) -> DataFrame:
    """keep, base, prediction and a Shapley value for each feature, of path-dependent conditional expectations.

    A leaf's game is a product over its path's features, of which each is 1 or 0 (the row passes its splits or not) when
    known and the share of training rows that pass when not. The Shapley value of such a product needs only the
    coefficients of a polynomial of the path's length. base plus the values is the prediction.
    """
    trees = [(w, _leaf_paths(n)) for w, n in _tree_arrays(model)]
    names = list(features)

    def shap(x: np.ndarray) -> tuple[float, np.ndarray]:
        """base and (rows, features): one polynomial for each row, all rows of a batch at once."""
        phi, base = np.zeros((len(x), len(names))), 0.0
        for weight, paths in trees:
            for value, path in paths:
                known = np.column_stack([(low < x[:, f]) & (x[:, f] <= high) for f, low, high, _ in path]).astype(float) if path else np.zeros((len(x), 0))
                share = np.array([s for *_, s in path])
                base += weight * value * float(share.prod())
                m = len(path)
                sizes = np.array([math.factorial(s) * math.factorial(m - 1 - s) / math.factorial(m) for s in range(m)])
                for i in range(m):
                    poly = np.zeros((len(x), m))
                    poly[:, 0] = 1.0
                    for j in range(m):
                        if j != i:
                            shifted = np.zeros_like(poly)
                            shifted[:, 1:] = poly[:, :-1]
                            poly = poly * share[j] + shifted * known[:, [j]]
                    phi[:, path[i][0]] += weight * value * (known[:, i] - share[i]) * (poly @ sizes)
        return base, phi

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            base, phi = shap(pdf[names].to_numpy(dtype=float))
            out = pdf[list(keep)].copy()
            out["base"] = base
            for k, f in enumerate(names):
                out[f] = phi[:, k]
            out["prediction"] = base + phi.sum(axis=1)
            yield out

    filled = df.select(*keep, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names])
    kinds = dict(df.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keep], "base double", *[f"{f} double" for f in names], "prediction double"])
    return filled.mapInPandas(run, schema)


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, Pearson, Spearman (average ranks) and mean difference, on complete pairs."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    ranked = mean_ranks(mean_ranks(cut(pairs), "a", "ra"), "b", "rb")
    return ranked.agg(F.count("*").alias("n"), F.round(F.corr("a", "b"), 4).alias("pearson"), F.round(F.corr("ra", "rb"), 4).alias("spearman"), F.round(exact_avg(F.col("a") - F.col("b"), 6), 4).alias("mean_diff"))
