"""Registered queries against DuckDB; all of them at 0.01 with PLAYSEQ_ALL_ORACLES set."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import __spark_entry__ as entry  # noqa: E402
from tools.check_oracles import compare, connect  # noqa: E402

SOME = [
    "complete_rounds_paired", "features_own_series", "features_opponent", "dist_move",
    "dist_prev_transition_prev_outcome", "player_dist_outcome_cournot_transition",
    "context_dist_prev_2move", "player_wcd_prev_2move", "ewcd_opponent_prev_move", "empirical_wcd",
    "summary_win_diff", "summary_win_diff_aligned", "info_gain_combined_series",
    "info_gain_figure_paired",
]
FULL = bool(os.environ.get("PLAYSEQ_ALL_ORACLES"))
SF_DIR = "/root/testdata/sf0.01" if FULL else "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_a_statement():
    added = {name for part in entry._added() for name in part.queries()}
    assert set(entry.queries()) - added == {n for n in entry.oracle_sql() if n not in added}


@pytest.mark.parametrize("name", list(entry.oracle_sql()) if FULL else SOME)
def test_query_equals_sql(spark, con, name):
    same, note = compare(spark, con, name, SF_DIR)
    assert same, note


def test_regression_at_a_scale_with_enough_games(spark):
    folder = "/root/testdata/sf0.01"
    for name in ("ols_coefficients", "ols_fit", "corr_table"):
        same, note = compare(spark, connect(folder), name, folder)
        assert same, note


def test_entry(spark):
    assert entry.entry(spark).count() > 0
