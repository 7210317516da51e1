"""Shapes of the physical plans: shuffles, pushed filters, no Python."""

import re
from dataclasses import replace

import pytest

import __spark_entry__ as entry
from playseq.domain import GAME_KEYS, PLAYER_KEYS
from playseq.operators.distributions import CELLS, DEPENDENCIES, distribution
from playseq.operators.entropy import entropies
from playseq.operators.sizes import Limits, Sizes
from playseq.operators.win_differential import empirical_wcd, expected_wcd
from playseq.plans.information_gain import player_entropies
from playseq.plans.study import Study
from playseq.plans.win_count import summary_win_diff
from playseq.sources import read_rounds, rounds_from_events


@pytest.fixture(scope="module")
def study(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("rounds") / "rounds")
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rounds_from_events(events).write.parquet(folder)
    stored = read_rounds(spark, folder, "parquet")
    # Sizes of a table without incomplete players, so no anti join is in the way.
    return Study.of(stored, min_rounds=1)


def plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def shuffles(df):
    return len(re.findall(r"(?<!Broadcast)Exchange (hash|range|single)", plan(df)))


def test_one_shuffle_serves_all_features_and_differentials(study):
    assert study.sizes.incomplete_players == 0
    assert shuffles(study.features()) == 1
    assert shuffles(expected_wcd(study.features())) == 1
    assert shuffles(summary_win_diff(study)) == 1


def test_a_wider_shuffle_is_still_the_only_one(study):
    wide = Study(study.rounds, replace(study.sizes, rows=10**9))
    assert shuffles(summary_win_diff(wide)) == 1
    assert ", 250)" in plan(wide.features())


def test_unused_windows_are_pruned(study):
    text = plan(distribution(study.features(), DEPENDENCIES["transition"]))
    assert len(re.findall(r"Window \[", text)) == 2  # the lag and the total
    assert "opponent" not in text


def test_entropies_shuffle_rounds_once_and_then_counts(study):
    df = entropies(study.features(PLAYER_KEYS))
    text = plan(df)
    assert shuffles(df) == 3
    assert study.sizes.games_per_player == 1
    assert shuffles(player_entropies(study)) == 1
    # The counts are combined before they leave the task that made them.
    assert text.index("partial_sum(n") > text.index("Exchange hashpartitioning(player_id")


def test_move_distribution_counts_before_shuffling(study):
    df = distribution(study.rounds, DEPENDENCIES["move"])
    text = plan(df)
    assert "partial_sum" in text[text.rindex("Exchange hash") :]
    assert re.search(r"PushedFilters: \[.*Not\(EqualTo\(player_move,none\)\)", text)
    assert "round_index" not in text[text.index("ReadSchema") :]


MOVE_ONLY = ("dist_move", "player_dist_move", "player_wcd_move", "ewcd_move", "entropy_move")


@pytest.mark.parametrize("name", MOVE_ONLY)
def test_registered_move_queries_count_before_shuffling(spark, name):
    text = plan(entry.queries()[name](spark, "/root/testdata/sf0.001"))
    # The deepest exchange of the main branch stands above the partial count.
    main = text[: text.index("BroadcastExchange")] if "BroadcastExchange" in text else text
    assert "partial_sum" in main[main.rindex("Exchange hash") :]


def test_registered_summary_reads_events_once(spark):
    text = plan(entry.queries()["summary_win_diff"](spark, "/root/testdata/sf0.001"))
    assert text.count("FileScan") == 1


@pytest.mark.parametrize("keys", [GAME_KEYS, PLAYER_KEYS])
@pytest.mark.parametrize("largest", [100, 10**11])
def test_no_exchange_of_rounds_at_the_session_default(study, keys, largest):
    sizes = Sizes(10**12, largest, largest, largest, 2, 1000, 763, 0)
    text = plan(Study(study.rounds, sizes).features(keys))
    narrow = re.findall(r"Exchange hashpartitioning\(([^)]*), 8\)", text)
    # Only edge rows of slices, which are few, go by the session's width.
    assert all("_across" in text or "edge" in n for n in narrow) and "50000)" in text


def test_empirical_differential_reads_three_columns(study):
    text = plan(empirical_wcd(study.rounds, study.sizes))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {
        "game_id", "player_id", "player_outcome",
    }


def test_no_python_in_any_plan(study):
    for df in (
        summary_win_diff(study),
        entropies(study.features(PLAYER_KEYS)),
        distribution(study.features(), DEPENDENCIES["prev_2move"], GAME_KEYS),
    ):
        assert not re.search(r"Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan(df))


def test_large_games_leave_the_shared_shuffle(study):
    sizes = Sizes(10**12, 10**11, 10**11, 10**11, 2, 1, 763, 0)
    large = Study(study.rounds, sizes)
    text = plan(large.features())
    assert "_block" in text and "Exchange hashpartitioning(game_id#" in text
    assert re.search(r"hashpartitioning\(game_id#\d+L?, round_index#\d+, 50000\)", text)


@pytest.mark.parametrize("rows, tasks", [(10**6, 10), (36 * 10**6, 360)])
def test_tasks_follow_what_the_rounds_become(study, rows, tasks):
    """summary_win_diff_twenty and others that count all dependencies: a task gets about 100,000 rounds."""
    grown = Study(study.rounds, replace(study.sizes, rows=rows))
    for df in (summary_win_diff(grown), player_entropies(grown)):
        text = plan(df)
        assert shuffles(df) == 1 and f", {tasks})" in text
        # Adaptive execution may merge neither.
        assert "REPARTITION_BY_NUM" in text


def test_rounds_are_dealt_once_for_what_they_become(spark):
    """Dealt where they are made, rounds aren't dealt again by the analysis."""
    folder = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{folder}/events.parquet")
    limits = Limits(rows_per_task=4000)
    rounds = rounds_from_events(events, cells=CELLS, limits=limits)
    made = Study.of(rounds, 1, limits)
    assert limits.tasks_for(made.sizes.rows * CELLS) > 8
    assert shuffles(summary_win_diff(made)) == 1
