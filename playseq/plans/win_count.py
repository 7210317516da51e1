"""Expected against empirical win-count differentials: regression and correlation."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import astuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playseq.domain import LABELLED_DEPENDENCIES, LABELS
from playseq.functions import label_of
from playseq.operators.distributions import CELLS
from playseq.operators.regression import Fit, Moments, fit, residuals
from playseq.operators.sequence import checkpoint
from playseq.operators.win_differential import (
    EXPECTED_WCD,
    empirical_wcd,
    expected_and_empirical_wcd,
    expected_wcd,
)
from playseq.plans.study import Study

EMPIRICAL = "empirical_wcd"

# Fixed values. Each residual: the dependency it is of, and the simpler ones regressed out of it.
RESIDUALS = {
    "opponent_prev_move_resid": ("opponent_prev_move", ("move", "cournot_transition")),
    "player_prev_move_resid": ("prev_move", ("move", "transition")),
    "player_prev_2move_resid": ("prev_2move", ("move", "prev_move", "transition")),
    "transition_outcome_resid": ("outcome_transition", ("transition", "cournot_transition")),
    "transition_prev_trans_outcome_resid": (
        "prev_transition_prev_outcome",
        ("outcome_transition", "outcome_cournot_transition"),
    ),
}

# Predictors of the full model: the base rates as they are, then what the composed
# dependencies add to them.
FULL_MODEL = (
    *(EXPECTED_WCD[name] for name in ("move", "transition", "cournot_transition")),
    *RESIDUALS,
)

RESIDUAL_OF = {of: residual for residual, (of, _) in RESIDUALS.items()}


def summary_win_diff(study: Study, **options) -> DataFrame:
    """Empirical and all nine expected differentials of each game that has every one."""
    columns = list(EXPECTED_WCD.values())
    options = {"game": study.game} | options
    if study.sizes.players_per_game <= study.limits.rows_per_task:
        both = expected_and_empirical_wcd(study.features(cells=CELLS), **options)
    else:
        empirical = empirical_wcd(study.rounds, study.sizes, study.limits, options["game"])
        expected = expected_wcd(study.features(cells=CELLS), **options).withColumnRenamed("game_id", "_game_id")
        # A missing game id is a game like any other.
        both = empirical.join(expected, F.col("game_id").eqNullSafe(F.col("_game_id")))
    return both.dropna(subset=columns).select("game_id", EMPIRICAL, *columns)


def residualise(summary: DataFrame, names: Sequence[str] = tuple(RESIDUALS)) -> DataFrame:
    """Add the named residual columns; their models share one pass over the table.

    The table, one row per game, is checkpointed first so that neither this pass nor
    a later fit repeats the analysis behind it.
    """
    games = checkpoint(summary)
    models = {
        name: (EXPECTED_WCD[of], [EXPECTED_WCD[n] for n in on])
        for name, (of, on) in RESIDUALS.items()
        if name in names
    }
    return games.withColumns(residuals(games, models))


def full_model(residualised: DataFrame) -> Fit:
    return fit(residualised, EMPIRICAL, FULL_MODEL)


def moments(summary: DataFrame) -> Moments:
    """What all fits and correlations need, from one aggregation of the per-game table.

    Residuals are linear in the differentials, so their moments follow from those of the raw columns.
    """
    found = Moments.of(summary, [EMPIRICAL, *EXPECTED_WCD.values()])
    for name, (of, on) in RESIDUALS.items():
        found = found.with_residual(name, found.fit(EXPECTED_WCD[of], [EXPECTED_WCD[n] for n in on]))
    return found


CORRELATIONS = T.StructType(
    [
        T.StructField("dependency", T.StringType()),
        T.StructField("correction", T.StringType()),
        T.StructField("corr", T.DoubleType()),
        T.StructField("se", T.DoubleType()),
    ]
)


def correlation_table(spark: SparkSession, games: Moments) -> DataFrame:
    """Correlation of each dependency with the empirical differential, raw and residual.

    The standard error counts the games, of which the table has one row each.
    """
    rows = []
    for name, label in zip(LABELLED_DEPENDENCIES, LABELS):
        for column, correction in ((EXPECTED_WCD[name], "Uncorrected"), (RESIDUAL_OF.get(name), "Corrected")):
            if column:
                corr = games.correlation(column, EMPIRICAL)
                known = corr is not None and games.rows > 2
                rows.append((label, correction, corr, math.sqrt(max(1 - corr * corr, 0.0) / (games.rows - 2)) if known else None))
    return spark.createDataFrame(rows, CORRELATIONS)


CORRELATION_TESTS = T.StructType(
    [
        T.StructField("dependency", T.StringType()),
        T.StructField("correction", T.StringType()),
        T.StructField("corr", T.DoubleType()),
        T.StructField("t_value", T.DoubleType()),
        T.StructField("df", T.LongType()),
        T.StructField("p_value", T.DoubleType()),
        T.StructField("lower", T.DoubleType()),
        T.StructField("upper", T.DoubleType()),
    ]
)


def correlation_tests(spark: SparkSession, games: Moments, level: float = 0.95) -> DataFrame:
    """The test of each correlation of the correlation table, with its confidence interval."""
    rows = []
    for name, label in zip(LABELLED_DEPENDENCIES, LABELS):
        for column, correction in ((EXPECTED_WCD[name], "Uncorrected"), (RESIDUAL_OF.get(name), "Corrected")):
            if column:
                rows.append((label, correction, *astuple(games.correlation_test(column, EMPIRICAL, level))))
    return spark.createDataFrame(rows, CORRELATION_TESTS)


def correlation_figure(table: DataFrame) -> DataFrame:
    """The correlation table with label order and one standard error to each side."""
    return table.select(
        "dependency",
        label_of("dependency", {label: i for i, label in enumerate(LABELS)}).alias("ordinal"),
        "correction",
        "corr",
        (F.col("corr") - F.col("se")).alias("lower"),
        (F.col("corr") + F.col("se")).alias("upper"),
    )
