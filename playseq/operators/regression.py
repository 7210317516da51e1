"""Ordinary least squares on a table of any length and a handful of predictors."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playseq.operators.sequence import SLICE, range_slices
from playseq.operators.sizes import LIMITS, Limits

INTERCEPT = "(Intercept)"

COEFFICIENTS = T.StructType(
    [
        T.StructField("term", T.StringType()),
        T.StructField("estimate", T.DoubleType()),
        T.StructField("std_error", T.DoubleType()),
        T.StructField("t_value", T.DoubleType()),
        T.StructField("p_value", T.DoubleType()),
    ]
)


# A predictor with a smaller share of its variance left by those before it is redundant.
TOLERANCE = 1e-11


@dataclass(frozen=True)
class Fit:
    """A fitted model; only its fixed-size parameters live on the driver.

    A redundant predictor has no estimate, and degrees of freedom go by rank.
    """

    target: str
    predictors: tuple[str, ...]
    estimates: tuple[float | None, ...]  # predictors, then intercept
    std_errors: tuple[float | None, ...]
    t_values: tuple[float | None, ...]
    p_values: tuple[float | None, ...]
    rows: int
    r2: float
    r2_adjusted: float | None
    degrees_of_model: int
    degrees_of_freedom: int
    residual_std_error: float | None

    def fitted(self) -> Column:
        value = F.lit(self.estimates[-1]).cast("double")
        for name, estimate in zip(self.predictors, self.estimates):
            if estimate is not None:
                value = value + F.col(name) * estimate
        return value

    def residual(self) -> Column:
        return F.col(self.target) - self.fitted()


@dataclass(frozen=True)
class CorrelationTest:
    corr: float | None
    t_value: float | None
    degrees_of_freedom: int
    p_value: float | None
    lower: float | None
    upper: float | None


@dataclass(frozen=True)
class Moments:
    """Means and population covariances of columns, over the rows that have all of them."""

    columns: tuple[str, ...]
    rows: int
    means: np.ndarray
    covariances: np.ndarray

    @classmethod
    def of(cls, df: DataFrame, columns: Sequence[str]) -> Moments:
        return cls.several(df, {"": columns})[""]

    @classmethod
    def several(cls, df: DataFrame, groups: Mapping[str, Sequence[str]]) -> dict[str, Moments]:
        """Moments of several groups of columns, each over its own complete rows, in one aggregation."""
        found: list[Column] = []
        for columns in groups.values():
            complete = F.lit(True)
            for c in columns:
                complete = complete & F.col(c).isNotNull()
            kept = [F.when(complete, F.col(c)) for c in columns]
            found.append(F.count_if(complete))
            found += [F.avg(c) for c in kept]
            found += [F.covar_pop(a, b) for i, a in enumerate(kept) for b in kept[: i + 1]]
        values = iter(df.agg(*(v.alias(f"_{i}") for i, v in enumerate(found))).first())
        moments = {}
        for name, columns in groups.items():
            n, k = next(values), len(columns)
            means = np.array([next(values) or 0.0 for _ in columns])
            covariances = np.zeros((k, k))
            for i in range(k):
                for j in range(i + 1):
                    covariances[i, j] = covariances[j, i] = next(values) or 0.0
            moments[name] = cls(tuple(columns), n, means, covariances)
        return moments

    def among(self, rows: Sequence[str], columns: Sequence[str]) -> np.ndarray:
        place = self.columns.index
        return self.covariances[np.ix_([place(c) for c in rows], [place(c) for c in columns])]

    def with_residual(self, name: str, fit: Fit) -> Moments:
        """With one more column, the residual of a model of these columns: it is linear in them."""
        weights = np.zeros(len(self.columns))
        weights[self.columns.index(fit.target)] = 1.0
        for predictor, estimate in zip(fit.predictors, fit.estimates):
            weights[self.columns.index(predictor)] -= estimate or 0.0
        with_it = self.covariances @ weights
        return Moments(
            (*self.columns, name),
            self.rows,
            np.append(self.means, self.means @ weights - (fit.estimates[-1] or 0.0)),
            np.block([[self.covariances, with_it[:, None]], [with_it[None], weights @ with_it]]),
        )

    def correlation(self, a: str, b: str) -> float | None:
        scale = math.sqrt(self.among([a], [a])[0, 0] * self.among([b], [b])[0, 0])
        return float(self.among([a], [b])[0, 0] / scale) if scale > 0 else None

    def correlation_test(self, a: str, b: str, level: float = 0.95) -> CorrelationTest:
        """Whether two columns are correlated, by Student's t; the interval is Fisher's.

        The interval takes four rows at least; a column that doesn't vary has no correlation.
        """
        corr, degrees = self.correlation(a, b), self.rows - 2
        if corr is None or degrees < 1:
            return CorrelationTest(corr, None, max(degrees, 0), None, None, None)
        left = max(1 - corr * corr, 0.0)
        t_value = corr * math.sqrt(degrees / left) if left else math.copysign(math.inf, corr)
        p_value = f_tail(t_value * t_value, 1, degrees) if left else 0.0
        lower = upper = None
        if self.rows > 3:
            z = math.atanh(corr) if left else math.copysign(math.inf, corr)
            reach = NormalDist().inv_cdf((1 + level) / 2) / math.sqrt(self.rows - 3)
            lower, upper = math.tanh(z - reach), math.tanh(z + reach)
        return CorrelationTest(corr, t_value, degrees, p_value, lower, upper)

    def fit(self, target: str, predictors: Sequence[str]) -> Fit:
        """Least squares with an intercept, by the normal equations of the correlations."""
        chosen: list[str] = []
        for c in predictors:
            own = self.among([c], [c])[0, 0]
            with_chosen = self.among(chosen, [c])[:, 0]
            explained = with_chosen @ np.linalg.solve(self.among(chosen, chosen), with_chosen) if chosen else 0.0
            if own > 0 and own - explained > TOLERANCE * own:
                chosen.append(c)
        k, degrees = len(chosen), self.rows - len(chosen) - 1
        total = self.among([target], [target])[0, 0]
        scale = np.sqrt(np.diag(self.among(chosen, chosen)))
        inverse = np.linalg.inv(self.among(chosen, chosen) / np.outer(scale, scale)) / np.outer(scale, scale)
        slopes = inverse @ self.among(chosen, [target])[:, 0]
        means = np.array([self.means[self.columns.index(c)] for c in chosen])
        intercept = self.means[self.columns.index(target)] - slopes @ means
        left = max(float(total - slopes @ self.among(chosen, [target])[:, 0]), 0.0)
        r2 = 1 - left / total if total > 0 else math.nan
        estimates = dict(zip(chosen, map(float, slopes))) | {INTERCEPT: float(intercept) if self.rows else None}
        errors: dict[str, float] = {}
        if degrees > 0:
            variance = left * self.rows / degrees
            spread = [*np.diag(inverse) / self.rows, 1 / self.rows + means @ inverse @ means / self.rows]
            errors = dict(zip([*chosen, INTERCEPT], (math.sqrt(variance * v) for v in spread)))
        terms = [*predictors, INTERCEPT]
        t_values = {c: estimates[c] / e for c, e in errors.items() if e > 0}
        return Fit(
            target=target,
            predictors=tuple(predictors),
            estimates=tuple(estimates.get(c) for c in terms),
            std_errors=tuple(errors.get(c) for c in terms),
            t_values=tuple(t_values.get(c) for c in terms),
            p_values=tuple(f_tail(t_values[c] ** 2, 1, degrees) if c in t_values else None for c in terms),
            rows=self.rows,
            r2=r2,
            r2_adjusted=1 - (1 - r2) * (self.rows - 1) / degrees if degrees > 0 else None,
            degrees_of_model=k,
            degrees_of_freedom=degrees,
            residual_std_error=math.sqrt(left * self.rows / degrees) if degrees > 0 else None,
        )


def fit(df: DataFrame, target: str, predictors: Sequence[str]) -> Fit:
    """Least squares with an intercept over the complete rows, aggregated in one pass."""
    return Moments.of(df, [target, *predictors]).fit(target, predictors)


def residuals(df: DataFrame, models: Mapping[str, tuple[str, Sequence[str]]]) -> dict[str, Column]:
    """Residual of each named model, (target, predictors), as a column expression.

    Each model is fitted on the rows that have all of its columns; one aggregation serves all.
    """
    moments = Moments.several(df, {name: (target, *on) for name, (target, on) in models.items()})
    return {name: moments[name].fit(target, on).residual() for name, (target, on) in models.items()}


def coefficient_table(spark: SparkSession, fitted: Fit) -> DataFrame:
    """One row per term, intercept first; a redundant term has no values."""
    columns = (fitted.estimates, fitted.std_errors, fitted.t_values, fitted.p_values)
    rows = list(zip((*fitted.predictors, INTERCEPT), *columns))
    return spark.createDataFrame([rows[-1], *rows[:-1]], COEFFICIENTS)


def fit_table(df: DataFrame, fitted: Fit, limits: Limits = LIMITS) -> DataFrame:
    """One row on the whole fit: R squared, residual error, F test, residual quartiles."""
    k, degrees = fitted.degrees_of_model, fitted.degrees_of_freedom
    f_value = p_value = None
    if degrees > 0 and k and fitted.r2 < 1:
        f_value = (fitted.r2 / k) / ((1 - fitted.r2) / degrees)
        p_value = f_tail(f_value, k, degrees)
    quartiles = quantiles(
        df.select(fitted.residual().alias("residual")),
        "residual",
        {"residual_min": 0.0, "residual_q1": 0.25, "residual_median": 0.5,
         "residual_q3": 0.75, "residual_max": 1.0},
        fitted.rows,
        limits,
    )
    facts = {
        "r_squared": fitted.r2,
        "adj_r_squared": fitted.r2_adjusted,
        "residual_std_error": fitted.residual_std_error,
        "f_statistic": f_value,
        "f_p_value": p_value,
    }
    return quartiles.select(
        F.lit(fitted.rows).cast("long").alias("n"),
        F.lit(k).cast("long").alias("df_model"),
        F.lit(degrees).cast("long").alias("df_residual"),
        *(F.lit(value).cast("double").alias(name) for name, value in facts.items()),
        "*",
    )


def quantiles(
    df: DataFrame, column: str, probabilities: dict[str, float], rows: int, limits: Limits = LIMITS
) -> DataFrame:
    """Exact quantiles of `rows` values, interpolated between neighbours, as one row."""
    values = df.select(column).filter(F.col(column).isNotNull())
    if rows <= limits.rows_per_task:
        found = values.agg(F.percentile(column, list(probabilities.values())).alias("found"))
        return found.select(*(F.col("found")[i].alias(n) for i, n in enumerate(probabilities)))
    # The built-in exact percentile holds all values in one place. Rank distinct values instead:
    # equal ones are counted before anything is ordered, so they can't fill a slice.
    counted = values.groupBy(column).count()
    sliced = range_slices(counted, [], [column], limits.tasks_for(rows))
    before = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sliced.groupBy(SLICE).agg(F.sum("count").alias("held")).select(
        F.col(SLICE).alias("_of"), F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before")
    )
    within = Window.partitionBy(SLICE).orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    # One offset a slice, so their number is bounded by that of partitions.
    ranked = sliced.withColumn("upto", F.sum("count").over(within)).join(F.broadcast(offsets), F.col(SLICE) == F.col("_of"))
    last = F.col("before") + F.col("upto")
    first = last - F.col("count") + 1

    def at(p: float) -> Column:
        place = (rows - 1) * p
        below = math.floor(place)
        share = place - below
        value = [F.max(F.when((first <= below + i) & (last >= below + i), F.col(column))) for i in (1, 2)]
        return value[0] if share == 0 else value[0] + (value[1] - value[0]) * share

    return ranked.agg(*(at(p).alias(n) for n, p in probabilities.items()))


def f_tail(f_value: float, k: int, degrees: int) -> float:
    """Upper tail of the F distribution with k and `degrees` degrees of freedom."""
    total = degrees + k * f_value
    if degrees > 100_000:
        return _large_tail(k * f_value / total, k / 2, degrees / 2)
    return _beta_share(degrees / total, k * f_value / total, degrees / 2, k / 2)


def _large_tail(y: float, b: float, a: float) -> float:
    """1 - I_y(b, a) for large a, where the continued fraction is slow: a series of positive terms."""
    if a * y > 700 + 10 * b:
        return 0.0  # below what a float tells from nothing
    term = total = 1.0
    for i in range(1_000_000):
        term *= (a + b + i) * y / (b + 1 + i)
        total += term
        if term <= 1e-17 * total:
            log_front = (b * math.log(y) if y > 0 else -math.inf) + a * math.log1p(-y) - _log_beta(a, b) - math.log(b)
            return max(1.0 - math.exp(log_front + math.log(total)), 0.0)
    raise ArithmeticError(f"the F tail did not converge: {y}, {b}, {a}")


def _log_beta(a: float, b: float) -> float:
    """Logarithm of the beta function; differences of large log-gammas are taken by their series."""
    a, b = max(a, b), min(a, b)
    if a < 50:
        return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)

    def rest(x: float) -> float:
        return 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)

    growth = (a + b - 0.5) * math.log1p(b / a) + b * math.log(a) - b + rest(a + b) - rest(a)
    return math.lgamma(b) - growth


def _beta_share(x: float, y: float, a: float, b: float) -> float:
    """Regularized incomplete beta function I_x(a, b), by its continued fraction; y is 1 - x, exactly."""
    if x <= 0.0 or y <= 0.0:
        return float(y <= 0.0)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_share(y, x, b, a)
    log_x = math.log(x) if x < 0.5 else math.log1p(-y)
    log_y = math.log(y) if y < 0.5 else math.log1p(-x)
    log_front = a * log_x + b * log_y - _log_beta(a, b)
    # Convergents by the fundamental recurrence, rescaled so they stay in range.
    before, now = (1.0, 0.0), (1.0, 1.0)
    share = 1.0
    for step in range(1, 100_000):
        m = step // 2
        if step % 2:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        after = tuple(n + term * o for n, o in zip(now, before))
        before, now = tuple(n / after[1] for n in now), (after[0] / after[1], 1.0)
        if abs(now[0] - share) <= 1e-15 * abs(now[0]):
            return math.exp(log_front) / (a * now[0])
        share = now[0]
    raise ArithmeticError(f"the F tail did not converge: I_{x}({a}, {b})")
