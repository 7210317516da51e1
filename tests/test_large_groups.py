"""Keys too large for one task are cut up; results must equal the plain windows."""

import random
from dataclasses import replace

import pytest

from playseq.domain import GAME_KEYS, PLAYER_KEYS, ROUNDS
from playseq.operators.distributions import DEPENDENCIES, distribution
from playseq.operators.features import features
from playseq.operators.regression import quantiles
from playseq.operators.sequence import number_rows, range_slices, shift
from playseq.operators.sizes import Limits, measure
from playseq.plans.study import Study
from playseq.plans.win_count import summary_win_diff
from playseq.sources import rounds_from_events

TINY = {
    "by sequence": Limits(rows_per_task=60, rounds_per_block=1000),
    "by block": Limits(rows_per_task=20, rounds_per_block=7),
    "by range": Limits(rows_per_task=1, rounds_per_block=3, partitions=12),
}


def rows_of(df):
    columns = sorted(df.columns)
    return sorted(repr(tuple(r)) for r in df.select(columns).collect())


@pytest.fixture(scope="module")
def skewed(spark):
    """One player holds a third of all rows, in many games; rounds have gaps."""
    rng = random.Random(3)
    rows = []
    for game in range(40):
        players = ("hot", f"p{game:02d}") if game % 3 else (f"q{game:02d}", f"p{game:02d}")
        rounds = 55 if game == 7 else rng.randint(2, 15)
        for number in range(1, rounds + 1):
            if rng.random() < 0.1:
                continue
            for player in players:
                if rng.random() < 0.05:
                    continue
                rows.append(
                    (f"g{game:02d}", player, number,
                     rng.choice(["rock", "paper", "scissors", "none"]),
                     rng.choice(["win", "loss", "tie", None]))
                )
    rng.shuffle(rows)
    return spark.createDataFrame(rows, ROUNDS).cache()


@pytest.mark.parametrize("keys", [GAME_KEYS, PLAYER_KEYS])
@pytest.mark.parametrize("limits", TINY.values(), ids=TINY)
def test_features_equal_plain_windows(skewed, keys, limits):
    plain = features(skewed, keys)
    assert rows_of(features(skewed, keys, limits=limits)) == rows_of(plain)


def test_measured_sizes(skewed):
    sizes = measure(skewed, min_rounds=10, limits=Limits(rounds_per_block=7))
    rows = [tuple(r) for r in skewed.collect()]

    def largest(*places):
        found = {}
        for row in rows:
            key = tuple(row[p] for p in places)
            found[key] = found.get(key, 0) + 1
        return max(found.values())

    assert sizes.rows == len(rows)
    assert sizes.rows_per_game == largest(0)
    assert sizes.rows_per_player == largest(1)
    assert sizes.rows_per_sequence == largest(0, 1)
    assert sizes.players_per_game == 2
    assert sizes.games_per_player == len({r[0] for r in rows if r[1] == "hot"})
    last = {}
    for row in rows:
        last[row[1]] = max(last.get(row[1], 0), row[2])
    assert sizes.incomplete_players == sum(v < 10 for v in last.values())


def test_measuring_nothing(spark):
    sizes = measure(spark.createDataFrame([], ROUNDS))
    assert sizes.rows == 0 and sizes.incomplete_players == 0


def test_more_than_two_players_in_a_round(spark):
    """The first row looks down, every other one up."""
    rows = [("g", p, n, m, "tie") for n in (1, 2) for p, m in zip("abc", ("rock", "paper", "scissors"))]
    df = spark.createDataFrame(rows, ROUNDS)
    for limits in (Limits(), Limits(rows_per_task=1, partitions=5)):
        got = {
            r.player_id: r.opponent_prev_move
            for r in features(df, limits=limits).filter("round_index = 2").collect()
        }
        assert got == {"a": "paper", "b": "rock", "c": "paper"}


def test_shift_across_range_slices(spark):
    df = spark.range(200).selectExpr("id % 2 AS k", "id AS t", "id * 10 AS v")
    outputs = {"back1": ("v", 1), "back2": ("v", 2), "ahead": ("v", -1)}
    plain = shift(df, ["k"], ["t"], outputs)
    assert rows_of(shift(df, ["k"], ["t"], outputs, range_count=17)) == rows_of(plain)


def test_slices_split_a_single_key(spark):
    df = spark.range(1000).selectExpr("0 AS k", "id AS t")
    sizes = [r["count"] for r in range_slices(df, ["k"], ["t"], 10).groupBy("_slice").count().collect()]
    assert len(sizes) > 5 and max(sizes) < 300


def test_numbering_across_range_slices(spark):
    df = spark.range(300).selectExpr("if(id < 200, 'hot', concat('k', id % 7)) AS k", "-id AS t")
    plain = number_rows(df, ["k"], ["t"], "n")
    assert rows_of(number_rows(df, ["k"], ["t"], "n", range_count=9)) == rows_of(plain)


def test_rounds_of_a_large_user(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for options in ({}, {"paired": True}, {"rounds_per_game": 9}):
        plain = rounds_from_events(events, **options)
        cut = rounds_from_events(events, **options, limits=Limits(rows_per_task=20, partitions=20))
        assert rows_of(cut) == rows_of(plain)


def test_incomplete_players_beyond_the_broadcast_limit(skewed):
    few = Limits(broadcast_rows=0)
    assert rows_of(Study.of(skewed, 10, few).rounds) == rows_of(Study.of(skewed, 10).rounds)


def test_summary_of_games_with_many_players(skewed):
    """Joining the two sides gives what counting them together gives."""
    study = Study.of(skewed, 1)
    many = Study(study.rounds, replace(study.sizes, players_per_game=100), Limits(rows_per_task=99, partitions=6))
    want = {r.game_id: r for r in summary_win_diff(study).collect()}
    got = {r.game_id: r for r in summary_win_diff(many).collect()}
    assert len(want) > 3 and set(got) == set(want)
    for game, row in want.items():
        assert list(got[game])[1:] == pytest.approx(list(row)[1:])


def test_quantiles_by_rank(spark):
    df = spark.range(1, 38).selectExpr("cast(id * id AS double) AS x")
    wanted = {"lo": 0.0, "q1": 0.25, "mid": 0.5, "p77": 0.77, "hi": 1.0}
    (plain,) = quantiles(df, "x", wanted, 37).collect()
    (ranked,) = quantiles(df, "x", wanted, 37, Limits(rows_per_task=4)).collect()
    assert list(ranked) == pytest.approx(list(plain))


def test_equal_values_do_not_fill_a_slice(spark):
    df = spark.range(1000).selectExpr("if(id < 900, 5.0D, cast(id AS double)) AS x")
    wanted = {"lo": 0.0, "q1": 0.25, "mid": 0.5, "q91": 0.91, "hi": 1.0}
    (plain,) = quantiles(df, "x", wanted, 1000).collect()
    (ranked,) = quantiles(df, "x", wanted, 1000, Limits(rows_per_task=40)).collect()
    assert list(ranked) == pytest.approx(list(plain))


@pytest.fixture(scope="module")
def odd(spark):
    """Unknown round numbers, repeated rounds, an unknown game, three players."""
    rng = random.Random(8)
    rows = []
    for game, players in (("g1", "ab"), ("g2", "abc"), (None, "de"), ("g3", "a")):
        for number in [*range(1, 9), 3, None, None, None]:
            for player in players:
                # Moves follow from the place, so rows that tie in the order are alike.
                move = "rock paper scissors none".split()[(number or 0) % 4 if number != 3 else 0]
                rows.append((game, player, number, move, "win" if (number or 0) % 2 else "loss"))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, ROUNDS).cache()


@pytest.mark.parametrize("keys", [GAME_KEYS, PLAYER_KEYS])
@pytest.mark.parametrize("limits", TINY.values(), ids=TINY)
def test_odd_rounds_equal_plain_windows(odd, keys, limits):
    assert measure(odd).unnumbered_per_game == 9
    assert rows_of(features(odd, keys, limits=limits)) == rows_of(features(odd, keys))


def test_opponents_without_a_round_number_are_paired(odd):
    """Two players, several rows without a number: each row has a neighbour."""
    two = features(odd.filter("game_id = 'g1'")).filter("round_index IS NULL AND prev_move IS NOT NULL")
    assert two.count() > 0 and two.filter("opponent_prev_move IS NULL").count() == 0


def test_games_without_an_id_stay_in_the_summary(odd):
    study = Study.of(odd, 1)
    many = Study(study.rounds, replace(study.sizes, players_per_game=100), Limits(rows_per_task=99, partitions=6))
    games = {r.game_id for r in summary_win_diff(study).collect()}
    assert None in games and {r.game_id for r in summary_win_diff(many).collect()} == games


def test_smoothed_grids_need_features_of_their_keys(odd):
    with pytest.raises(ValueError, match="need features"):
        distribution(features(odd, PLAYER_KEYS), DEPENDENCIES["prev_2move"], GAME_KEYS)
