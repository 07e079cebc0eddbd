"""Regressions of a volume whose months at the ceiling are lower bounds: a normal (Tobit) and a Weibull model.

Both are fitted by Newton's steps. A step is one pass over the table: every partition sums the log-likelihood, its
gradient and its second derivatives, Spark adds these, and the driver solves a system as large as the features.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandry.session import cut

#: (log-likelihood, gradient, second derivatives) at some parameters.
Sums = tuple[float, np.ndarray, np.ndarray]


class NotConverged(RuntimeError):
    """The likelihood could be raised no further, or not in the given number of steps."""


def normal_tail(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log of the normal distribution function, density over it): a power series, and a continued fraction below -3."""
    s = np.asarray(s, dtype=float)
    log_density = -0.5 * s * s - 0.5 * math.log(2 * math.pi)
    t = np.clip(s, -3.0, 8.0)
    term, series = t.copy(), t.copy()
    for k in range(1, 101):
        term = term * t * t / (2 * k + 1)
        series = series + term
    whole = 0.5 + np.exp(-0.5 * t * t) / math.sqrt(2 * math.pi) * series
    x = np.maximum(-s, 3.0)
    below = x.copy()
    for k in range(80, 0, -1):
        below = x + k / below
    far = s < -3.0
    return np.where(far, log_density - np.log(below), np.log(whole)), np.where(far, below, np.exp(log_density) / whole)


def tobit_sums(x: np.ndarray, y: np.ndarray, censored: np.ndarray, p: np.ndarray) -> Sums:
    """Of a normal regression of y on x, a censored y being a lower bound. p is (beta / sigma, 1 / sigma), in which the
    log-likelihood is concave."""
    w = np.c_[x, -y]
    s, seen, theta = w @ p, ~censored, p[-1]
    log_tail, mills = normal_tail(s[censored])
    value = seen.sum() * (math.log(theta) - 0.5 * math.log(2 * math.pi)) - 0.5 * float((s[seen] ** 2).sum()) + float(log_tail.sum())
    gradient = w[censored].T @ mills - w[seen].T @ s[seen]
    bend = np.where(censored, 0.0, 1.0)
    bend[censored] = mills * (mills + s[censored])
    hessian = -(w * bend[:, None]).T @ w
    gradient[-1] += seen.sum() / theta
    hessian[-1, -1] -= seen.sum() / theta**2
    return value, gradient, hessian


def weibull_sums(x: np.ndarray, log_t: np.ndarray, censored: np.ndarray, p: np.ndarray) -> Sums:
    """Of Weibull durations with log scale x @ beta and log shape a; p is (beta, a), a censored duration a lower bound."""
    shape, d = math.exp(p[-1]), (~censored).astype(float)
    z = np.minimum(shape * (log_t - x @ p[:-1]), 500.0)
    e = np.exp(z)
    value = float((d * (p[-1] + z - log_t) - e).sum())
    slope = -shape * (d - e)
    gradient = np.r_[x.T @ slope, float((d + (d - e) * z).sum())]
    hessian = np.empty((len(p), len(p)))
    hessian[:-1, :-1] = -(x * (shape**2 * e)[:, None]).T @ x
    hessian[-1, :-1] = hessian[:-1, -1] = x.T @ (slope + shape * e * z)
    hessian[-1, -1] = float(((d - e) * z - e * z * z).sum())
    return value, gradient, hessian


def climb(evaluate: Callable[[np.ndarray], Sums], start: np.ndarray, n: int, allowed: Callable[[np.ndarray], bool] = lambda p: True, rounds: int = 100, tolerance: float = 1e-10) -> np.ndarray:
    """Parameters at which the likelihood is greatest: Newton's steps, halved until they gain and stay allowed, and turned
    towards the gradient where it isn't concave. Raises NotConverged rather than return what hasn't converged."""
    p, (value, gradient, hessian) = start, evaluate(start)
    for _ in range(rounds):
        damp, steepest = 0.0, np.abs(np.diag(hessian)).max() + 1e-12
        while True:
            try:
                np.linalg.cholesky(damp * np.eye(len(p)) - hessian)
                break
            except np.linalg.LinAlgError:
                damp = max(10 * damp, 1e-9 * steepest)
                if damp > 1e6 * steepest:
                    raise NotConverged("no direction to go") from None
        step = np.linalg.solve(damp * np.eye(len(p)) - hessian, gradient)
        gain = float(gradient @ step)
        if gain <= tolerance * n:
            return p
        size = 1.0
        while True:
            new = p + size * step
            if allowed(new):
                found = evaluate(new)
                if math.isfinite(found[0]) and found[0] >= value + 1e-4 * size * gain:
                    break
            size /= 2
            if size < 1e-9:
                raise NotConverged("no step gains")
        p, (value, gradient, hessian) = new, found
    raise NotConverged(f"{rounds} steps")


@dataclass
class Table:
    """Rows of outlet_id, volume, censored and the features that vary, with their means and deviations."""

    df: DataFrame
    names: list[str]
    centre: np.ndarray
    spread: np.ndarray
    n: int
    start: float

    def sums(self, of: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum over partitions of what a function makes of (1 and standardised features, volume, censored)."""
        names, centre, spread = self.names, self.centre, self.spread

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = 0.0
            for pdf in parts:
                x = np.c_[np.ones(len(pdf)), (pdf[names].to_numpy(dtype=float) - centre) / spread]
                total = total + of(x, pdf["volume"].to_numpy(dtype=float), pdf["censored"].to_numpy() > 0)
            if np.ndim(total):
                yield pd.DataFrame({"place": np.arange(len(total)), "part": total})

        got = self.df.mapInPandas(run, "place int, part double").groupBy("place").agg(F.sum("part")).orderBy("place").collect()  # of a fixed size
        return np.array([r[1] for r in got])

    def evaluator(self, of: Callable[..., Sums], outcome: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], Sums]:
        def evaluate(p: np.ndarray) -> Sums:
            k = len(p)

            def flat(x: np.ndarray, volume: np.ndarray, censored: np.ndarray) -> np.ndarray:
                value, gradient, hessian = of(x, outcome(volume), censored, p)
                return np.r_[value, gradient, hessian.ravel()]

            s = self.sums(flat)
            return float(s[0]), s[1 : 1 + k], s[1 + k :].reshape(k, k)

        return evaluate


def table(panel: DataFrame, features: Sequence[str], outcome) -> Table:
    """panel (outlet_id, volume, censored, features) with nulls of features as 0, rows without a volume left out."""
    names = list(features)
    own = cut(panel.where(F.col("volume").isNotNull()).select("outlet_id", F.col("volume").cast("double").alias("volume"), F.coalesce(F.col("censored").cast("int"), F.lit(0)).alias("censored"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names]))
    row = own.agg(F.count("*"), F.avg(outcome(F.col("volume"))), *[F.avg(c) for c in names], *[F.stddev_pop(c) for c in names]).first()
    n, mean, rest = row[0], row[1], row[2:]
    vary = [k for k in range(len(names)) if (rest[len(names) + k] or 0.0) > 1e-9]
    return Table(own, [names[k] for k in vary], np.array([rest[k] for k in vary], dtype=float), np.array([rest[len(names) + k] for k in vary], dtype=float), n, mean or 0.0)


def linear(data: Table, beta: np.ndarray):
    """The regression's mean as a column."""
    own = zip(beta[1:], data.spread, data.centre, data.names, strict=True)
    return sum((F.lit(float(b / s)) * (F.col(c) - float(m)) for b, s, m, c in own), F.lit(float(beta[0])))


def fit_tobit(data: Table, rounds: int = 100) -> tuple[np.ndarray, float]:
    """(beta, sigma) of log1p(volume) on standardised features, from least squares over the months that aren't censored
    (over all where none is)."""
    p = len(data.names) + 1

    def squares(x: np.ndarray, volume: np.ndarray, censored: np.ndarray) -> np.ndarray:
        y, own = np.log1p(volume), [~censored, np.ones(len(censored), dtype=bool)]
        return np.concatenate([np.r_[(x[k].T @ x[k]).ravel(), x[k].T @ y[k], y[k] @ y[k], k.sum()] for k in own])

    both = data.sums(squares).reshape(2, -1)
    s = both[0] if both[0][-1] > p else both[1]
    xx, xy, yy, n = s[: p * p].reshape(p, p), s[p * p : p * p + p], s[-2], s[-1]
    beta = np.linalg.lstsq(xx, xy, rcond=None)[0]
    sigma = max(math.sqrt(max((yy - 2 * beta @ xy + beta @ xx @ beta) / n, 0.0)), 1e-3)
    found = climb(data.evaluator(tobit_sums, np.log1p), np.r_[beta / sigma, 1 / sigma], data.n, lambda q: q[-1] > 0, rounds)
    return found[:-1] / found[-1], float(1 / found[-1])


def tobit(panel: DataFrame, features: Sequence[str], rounds: int = 100) -> DataFrame:
    """(outlet_id, tobit): latent demand of a regression of log1p(volume) whose censored months are lower bounds: each
    outlet's mean, back in litres. Features that don't vary are left out; an empty panel gives no rows."""
    data = table(panel, features, F.log1p)
    if not data.n:
        return data.df.select("outlet_id", F.lit(0.0).alias("tobit"))
    beta, _ = fit_tobit(data, rounds)
    return data.df.groupBy("outlet_id").agg(F.expm1(F.avg(linear(data, beta))).alias("tobit"))


def fit_weibull(data: Table, penalty: float = 0.01, rounds: int = 100) -> tuple[np.ndarray, float]:
    """(beta, shape) of max(volume, 1): log scale beta on standardised features. The mean log-likelihood is lowered by the
    penalty times the sum of the squares of beta but for its constant."""
    own, n = data.evaluator(weibull_sums, lambda volume: np.log(np.maximum(volume, 1.0))), data.n

    def penalised(p: np.ndarray) -> Sums:
        value, gradient, hessian = own(p)
        ridge = np.r_[0.0, np.full(len(p) - 2, penalty * n), 0.0]
        return value - float(ridge @ (p * p)), gradient - 2 * ridge * p, hessian - 2 * np.diag(ridge)

    found = climb(penalised, np.r_[data.start, np.zeros(len(data.names)), 0.0], n, rounds=rounds)
    return found[:-1], math.exp(found[-1])


def survival(panel: DataFrame, features: Sequence[str], penalty: float = 0.01, rounds: int = 100) -> DataFrame:
    """(outlet_id, weibull): each outlet's mean of the expected volume, by a model of max(volume, 1) as a duration that a
    censored month cuts short. Features that don't vary are left out; an empty panel gives no rows."""
    data = table(panel, features, lambda v: F.log(F.greatest(v, F.lit(1.0))))
    if not data.n:
        return data.df.select("outlet_id", F.lit(0.0).alias("weibull"))
    beta, shape = fit_weibull(data, penalty, rounds)
    return data.df.groupBy("outlet_id").agg(F.avg(F.exp(linear(data, beta)) * math.gamma(1 + 1 / shape)).alias("weibull"))
