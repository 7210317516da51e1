"""Values worked out by hand on one game of four rounds."""

import math

import pytest
from pyspark.sql import functions as F

from playseq.domain import GAME_KEYS, PLAYER_KEYS
from playseq.operators.distributions import CONTEXTS, DEPENDENCIES, LAPLACE, distribution
from playseq.operators.entropy import entropies
from playseq.operators.win_differential import empirical_wcd, expected_wcd, player_expected_wcd
from playseq.plans.study import Study


@pytest.fixture(scope="module")
def study(hand):
    return Study.of(hand, min_rounds=4)


@pytest.fixture(scope="module")
def feats(study):
    return study.features(GAME_KEYS).cache()


def counts(df, *columns):
    return {tuple(r[c] for c in ("player_id", *columns)): r["n"] for r in df.collect()}


def test_move_counts(study):
    got = counts(distribution(study.rounds, DEPENDENCIES["move"]), "player_move")
    assert got == {
        ("a", "rock"): 1, ("a", "paper"): 1, ("a", "scissors"): 1,
        ("b", "rock"): 1, ("b", "paper"): 2, ("b", "scissors"): 1,
    }


def test_transitions(feats):
    got = counts(distribution(feats, DEPENDENCIES["transition"]), "transition")
    assert got == {("a", "+"): 1, ("b", "0"): 1, ("b", "-"): 2}


def test_cournot_pairs_before_filtering(feats):
    got = counts(distribution(feats, DEPENDENCIES["cournot_transition"]), "cournot_transition")
    assert got == {("a", "0"): 1, ("a", "-"): 1, ("b", "+"): 1, ("b", "-"): 1}


def test_cournot_given_outcome_filters_before_pairing(feats):
    which = DEPENDENCIES["outcome_cournot_transition"]
    got = counts(distribution(feats, which), "prev_outcome", "cournot_transition_both")
    assert got == {("a", "loss", "0"): 1, ("b", "win", "+"): 1}


def test_context_counts(feats):
    got = counts(distribution(feats, CONTEXTS["prev_move"]), "prev_move")
    assert got == {("a", "rock"): 1, ("a", "paper"): 1, ("b", "paper"): 2, ("b", "rock"): 1}
    got = counts(distribution(feats, CONTEXTS["prev_outcome"]), "prev_outcome")
    assert got == {("a", "loss"): 2, ("a", "tie"): 1, ("b", "win"): 2, ("b", "tie"): 1}


def test_moves_given_previous_move(feats):
    got = counts(distribution(feats, DEPENDENCIES["prev_move"]), "prev_move", "player_move")
    assert got == {
        ("a", "rock", "paper"): 1,
        ("b", "paper", "paper"): 1, ("b", "paper", "rock"): 1, ("b", "rock", "scissors"): 1,
    }


@pytest.mark.parametrize(
    "smoothing, expected, total",
    [("reference", (1 / 2, 1 / 3, 1 / 3), 7 / 6), (LAPLACE, (1 / 2, 1 / 4, 1 / 4), 1.0)],
)
def test_smoothing(feats, smoothing, expected, total):
    table = distribution(feats, DEPENDENCIES["prev_2move"], GAME_KEYS, smoothing)
    p = {
        (r.player_id, r.prev_move, r.prev_move2, r.player_move): r.p for r in table.collect()
    }
    assert len(p) == 54
    got = [p["b", "paper", "paper", m] for m in ("rock", "paper", "scissors")]
    assert got == pytest.approx(expected) and sum(got) == pytest.approx(total)
    assert all(v == pytest.approx(1 / 3) for k, v in p.items() if k[0] == "a")


def test_entropy_of_smoothed_context(feats):
    bits = lambda *ps: -sum(p * math.log2(p) for p in ps)
    assert bits(1 / 2, 1 / 3, 1 / 3) == pytest.approx(1.556642, abs=1e-6)
    for smoothing, after_pp in (("reference", bits(1 / 2, 1 / 3, 1 / 3)), (LAPLACE, 1.5)):
        after_rp = after_pp  # one observed cell in either context
        got = {
            r.player_id: r.entropy_prev_2move
            for r in entropies(feats, ["prev_2move"], GAME_KEYS, smoothing).collect()
        }
        # b's two-move contexts: (paper, paper) before round 3 and (rock, paper) before round 4.
        assert got["b"] == pytest.approx((after_pp + after_rp) / 2)
        assert got["a"] == pytest.approx(math.log2(3))


def test_entropy_given_previous_move(feats):
    got = {r.player_id: r.entropy_prev_move for r in entropies(feats, ["prev_move"]).collect()}
    # a's context "paper" has no following move, so its weight of one half is lost.
    assert got == {"a": pytest.approx(0.0), "b": pytest.approx(2 / 3)}


def test_expected_differential_of_moves(study):
    players = player_expected_wcd(study.rounds, ["move"])
    got = {r.player_id: r.max_exp_wcd_move_dist for r in players.collect()}
    assert got == {"a": pytest.approx(0.0, abs=1e-12), "b": pytest.approx(75.0)}
    (game,) = expected_wcd(study.rounds, ["move"]).collect()
    assert game.max_exp_wcd_move_dist == pytest.approx(37.5)


def test_game_with_a_winless_player_has_no_empirical_differential(study):
    assert empirical_wcd(study.rounds, study.sizes).count() == 0


def test_positional_alignment_reverses_the_cycle(feats):
    name = "prev_move"
    column = "max_exp_wcd_player_prev_move"
    found = {
        a: {r.player_id: r[column] for r in player_expected_wcd(feats, [name], alignment=a).collect()}
        for a in ("positional", "aligned")
    }
    # b after paper plays paper or rock evenly: v = (s - p, r - s, p - r) = (-.5, .5, 0),
    # after rock always scissors: v = (1, -1, 0).
    assert found["aligned"]["b"] == pytest.approx((0.5 + 1) * 100)
    assert found["positional"]["b"] == pytest.approx((0.5 + 1) * 100)
    # a after rock always paper: v = (-1, 0, 1); both signs reach one.
    assert found["aligned"]["a"] == pytest.approx(100)


def test_unknown_arguments_are_refused(feats):
    with pytest.raises(ValueError):
        distribution(feats, DEPENDENCIES["prev_2move"], smoothing="none")
    with pytest.raises(ValueError):
        player_expected_wcd(feats, ["move"], alignment="sideways")


def test_row_order_does_not_matter(hand, study):
    again = Study.of(hand.orderBy(F.rand(7)), min_rounds=4).features()
    columns = sorted(again.columns)
    assert sorted(map(repr, again.select(columns).collect())) == sorted(
        map(repr, study.features().select(columns).collect())
    )
