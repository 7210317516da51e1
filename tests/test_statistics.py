"""Regression and correlation against numpy, and the properties results must have."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from playseq.domain import MOVES
from playseq.functions import cyclic_transition
from playseq.operators.correlation import correlations
from playseq.operators.distributions import DEPENDENCIES, LAPLACE, distribution
from playseq.operators.regression import Moments, coefficient_table, f_tail, fit, fit_table, residuals
from playseq.operators.win_differential import expected_wcd
from playseq.plans.information_gain import (
    CORRECTIONS,
    corrected_gains,
    gains,
    information_gain_combined,
    information_gain_summary,
)
from playseq.operators.entropy import ENTROPY
from playseq.plans.study import Study
from playseq.sources import rounds_from_events


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 3)) * [1, 40, 0.1] + [0, 100, 3]
    y = 2 + x @ [1.5, -0.2, 30] + rng.normal(size=60)
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))],
                               "id int, a double, b double, c double, y double")
    return df, np.column_stack([np.ones(60), x]), y


def test_least_squares(sample):
    df, design, y = sample
    fitted = fit(df, "y", ["a", "b", "c"])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    resid = y - design @ beta
    variance = resid @ resid / 56
    errors = np.sqrt(variance * np.diag(np.linalg.inv(design.T @ design)))
    table = {r.term: r for r in coefficient_table(df.sparkSession, fitted).collect()}
    for i, term in enumerate(["(Intercept)", "a", "b", "c"]):
        assert table[term].estimate == pytest.approx(beta[i], rel=1e-9)
        assert table[term].std_error == pytest.approx(errors[i], rel=1e-9)
        assert table[term].t_value == pytest.approx(beta[i] / errors[i], rel=1e-9)
    (row,) = fit_table(df, fitted).collect()
    assert row.residual_std_error == pytest.approx(math.sqrt(variance))
    assert row.r_squared == pytest.approx(1 - resid @ resid / ((y - y.mean()) ** 2).sum())
    assert [row.residual_min, row.residual_q1, row.residual_median, row.residual_q3, row.residual_max] == (
        pytest.approx(list(np.quantile(resid, [0, 0.25, 0.5, 0.75, 1])))
    )
    got = np.array([r.e for r in df.select("id", fitted.residual().alias("e")).orderBy("id").collect()])
    assert got == pytest.approx(resid)
    assert abs(got.sum()) < 1e-9 and np.abs(design.T @ got).max() < 1e-7


def test_residuals_of_several_models_in_one_pass(sample):
    df, design, y = sample
    df = df.withColumn("twice", F.col("a") * 2)
    found = residuals(df, {"one": ("y", ["a", "c"]), "same": ("y", ["a", "twice", "c"]), "b": ("b", ["a"])})
    rows = df.withColumns(found).orderBy("id").collect()
    for name, target, on in (("one", y, [0, 1, 3]), ("same", y, [0, 1, 3]), ("b", design[:, 2], [0, 1])):
        x = design[:, on]
        want = target - x @ np.linalg.lstsq(x, target, rcond=None)[0]
        assert [r[name if name != "b" else "b"] for r in rows] == pytest.approx(list(want), abs=1e-9)


def test_only_the_redundant_term_is_unknown(sample):
    df = sample[0].withColumn("twice", F.col("a") * 2)
    fitted, plain = fit(df, "y", ["a", "twice", "b"]), fit(df, "y", ["a", "b"])
    for name in ("estimates", "std_errors", "t_values", "p_values"):
        a, twice, b, intercept = getattr(fitted, name)
        assert twice is None
        assert (a, b, intercept) == pytest.approx(getattr(plain, name))
    assert fitted.degrees_of_freedom == plain.degrees_of_freedom == 57
    assert coefficient_table(df.sparkSession, fitted).count() == 4


def test_each_model_uses_its_own_complete_rows(spark):
    rows = [(1.0, 2.0, 5.0), (2.0, None, 1.0), (3.0, 7.0, None), (5.0, 1.0, 2.0), (4.0, 3.0, 9.0), (2.5, 0.0, 4.0)]
    df = spark.createDataFrame(rows, "x double, y double, z double")
    got = df.withColumns(residuals(df, {"of_y": ("y", ["x"]), "of_z": ("z", ["x"])})).collect()
    for name, place in (("of_y", 1), ("of_z", 2)):
        whole = np.array([(r[0], r[place]) for r in rows if r[place] is not None])
        x = np.column_stack([np.ones(len(whole)), whole[:, 0]])
        want = whole[:, 1] - x @ np.linalg.lstsq(x, whole[:, 1], rcond=None)[0]
        assert [r[name] for r in got if r[name] is not None] == pytest.approx(list(want))


def test_moments_of_residuals_follow_from_raw_columns(sample):
    df, _, _ = sample
    moments = Moments.of(df, ["y", "a", "b", "c"])
    moments = moments.with_residual("left", moments.fit("c", ["a", "b"]))
    table = df.withColumn("left", fit(df, "c", ["a", "b"]).residual())
    direct = fit(table, "y", ["a", "left"])
    assert moments.fit("y", ["a", "left"]).estimates == pytest.approx(direct.estimates, rel=1e-6)
    assert moments.correlation("left", "y") == pytest.approx(table.corr("left", "y"))


def test_more_predictors_than_rows(sample):
    df = sample[0].limit(3)
    fitted = fit(df, "y", ["a", "b", "c"])
    assert coefficient_table(df.sparkSession, fitted).count() == 4
    (row,) = fit_table(df, fitted).collect()
    assert row.adj_r_squared is row.f_statistic is row.residual_std_error is None


def test_f_tail():
    # One numerator degree: the square of Student's t, here with one degree (Cauchy).
    for t in (0.3, 1.0, 5.0):
        assert f_tail(t * t, 1, 1) == pytest.approx(1 - 2 * math.atan(t) / math.pi)
    assert f_tail(0.0, 3, 9) == pytest.approx(1.0)
    # With ever more denominator degrees, k times F is chi-square; for k = 8 its tail is a finite sum.
    for degrees in (10**10, 10**12):
        for f in (0.2, 1.0, 2.5):
            half = 8 * f / 2
            limit = math.exp(-half) * sum(half**i / math.factorial(i) for i in range(4))
            assert f_tail(f, 8, degrees) == pytest.approx(limit, abs=1e-9)


def test_correlations(sample):
    df, design, y = sample
    got = {r.metric: r for r in correlations(df, ["a", "b"], "y", "id").collect()}
    for i, name in ((1, "a"), (2, "b")):
        r = np.corrcoef(design[:, i], y)[0, 1]
        assert got[name].corr == pytest.approx(r)
        assert got[name].se == pytest.approx(math.sqrt((1 - r * r) / 58))


def test_cyclic_transition(spark):
    moves = [*MOVES, "none", None]
    df = spark.createDataFrame([(a, b) for a in moves for b in moves], "a string, b string")
    for r in df.withColumn("t", cyclic_transition("a", "b")).collect():
        if r.a in MOVES and r.b in MOVES:
            assert r.t == "0+-"[(MOVES.index(r.b) - MOVES.index(r.a)) % 3]
        elif r.a != r.b or r.a is None:
            assert r.t is None


@pytest.fixture(scope="module")
def study(spark):
    return Study.of(rounds_from_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet")), 60)


@pytest.mark.parametrize("name", list(DEPENDENCIES))
def test_probabilities_sum_to_one(study, name):
    d = DEPENDENCIES[name]
    table = distribution(study.features(), d, smoothing=LAPLACE)
    sums = table.groupBy("game_id", "player_id", *d.context).agg(F.sum("p").alias("p"))
    assert sums.filter(F.abs(F.col("p") - 1) > 1e-12).count() == 0 and sums.count() > 0


def test_aligned_move_differential_is_never_negative(study):
    assert expected_wcd(study.rounds, ["move"], alignment="aligned").filter(
        "max_exp_wcd_move_dist < 0"
    ).count() == 0


def test_corrections_read_corrected_values(spark):
    names = list(ENTROPY)
    values = {n: 0.1 * (i + 1) for i, n in enumerate(names)}
    wide = spark.createDataFrame([("p", *values.values())], ["player_id", *ENTROPY.values()])
    want = {n: math.log2(3) - v for n, v in values.items()}
    for name, simpler in CORRECTIONS.items():
        want[name] -= sum(want[s] for s in simpler)
    (got,) = corrected_gains(gains(wide)).collect()
    for name, column in ENTROPY.items():
        assert got[column] == pytest.approx(want[name])


def test_summary_null_policy(spark):
    columns = list(ENTROPY.values())
    rows = [("p", *[1.0] * 9), ("q", *[0.5] * 9), ("r", *[0.25] * 8, None)]
    wide = spark.createDataFrame(rows, ["player_id", *columns])
    combined = information_gain_combined(wide)
    assert combined.count() == 3 * 2 * 8
    gone = (information_gain_summary(combined)
            .filter("corrected = 'Uncorrected' AND mean_information_gain IS NULL").collect())
    assert [r.entropy_type for r in gone] == ["entropy_prev_transition_prev_outcome"]
    skipped = information_gain_summary(combined, "skip")
    assert skipped.filter("mean_information_gain IS NULL").count() == 0


def test_correlation_test_of_published_values(spark):
    """Nine pairs whose test is printed to seven digits in textbooks."""
    x = [44.4, 45.9, 41.9, 53.3, 44.7, 44.1, 50.7, 45.2, 60.1]
    y = [2.6, 3.1, 2.5, 5.0, 3.6, 4.0, 5.2, 2.8, 3.8]
    rows = [*zip(x, y, strict=True), (1.0, None), (None, 2.0)]
    moments = Moments.of(spark.createDataFrame(rows, "x double, y double"), ["x", "y"])
    found = moments.correlation_test("x", "y")
    assert found.degrees_of_freedom == 7
    assert found.corr == pytest.approx(0.5711816, abs=5e-8)
    assert found.t_value == pytest.approx(1.8411, abs=5e-5)
    assert found.p_value == pytest.approx(0.1082, abs=5e-5)
    assert (found.lower, found.upper) == pytest.approx((-0.1497426, 0.8955795), abs=5e-8)
    narrow = moments.correlation_test("x", "y", level=0.5)
    assert found.lower < narrow.lower < found.corr < narrow.upper < found.upper


@pytest.mark.parametrize(
    "rows,want",
    [
        ([], (None, None, 0, None, None, None)),
        ([(1.0, 1.0), (1.0, 2.0), (1.0, 3.0)], (None, None, 1, None, None, None)),
        ([(1.0, 1.0), (2.0, 0.0)], (-1.0, None, 0, None, None, None)),
    ],
)
def test_correlation_test_of_too_little(spark, rows, want):
    found = Moments.of(spark.createDataFrame(rows, "x double, y double"), ["x", "y"]).correlation_test("x", "y")
    assert (found.corr, found.t_value, found.degrees_of_freedom, found.p_value, found.lower, found.upper) == pytest.approx(want)
