"""Games of any number of choices: category sets as inputs, and smoothing without a grid."""

import math
import random
from collections import defaultdict

import pytest

from playseq.domain import GAME_KEYS, PAYOFF, ROUNDS, RPS, Game
from playseq.functions import cyclic_transition
from playseq.operators.distributions import CONTEXTS, LAPLACE, REFERENCE, contexts, dependencies, distribution
from playseq.operators.entropy import ENTROPY, WEIGHTED_BY, entropies
from playseq.operators.win_differential import ALIGNED, EXPECTED_WCD, best_responses, player_expected_wcd
from playseq.plans.study import Study

# Payoffs whose rows don't sum to zero, so that uniform play is worth something.
UNEVEN = Game(("rock", "paper", "scissors"), ((1.0, -2.0, 3.0), (4.0, 0.5, -1.0), (-3.0, 2.0, 0.0)))
FOUR = Game(
    ("d", "a", "c", "b"),
    ((0.0, -1.0, 1.0, 2.0), (1.0, 0.0, -1.0, 0.5), (-1.0, 1.0, 0.0, 0.0), (0.25, -1.0, 1.0, 0.0)),
    cycle=("a", "b", "c", "d"),
    transition_payoff=PAYOFF,
)
TWENTY = Game(
    tuple(f"c{i:02}" for i in range(20)),
    tuple(tuple(float((i * 7 + j * 3) % 5 - 1) for j in range(20)) for i in range(20)),
    transition_payoff=PAYOFF,
)


@pytest.fixture(scope="module")
def studies(spark):
    """For each game, pairs of players of 40 rounds; one player never moves, one plays a choice nobody knows."""
    found = {}
    for name, game in (("uneven", UNEVEN), ("four", FOUR), ("twenty", TWENTY)):
        rng = random.Random(name)
        rows = []
        for number in range(3):
            for player in ("a", "b"):
                moves = [rng.choice(game.choices[: 2 + number] + ("none",)) for _ in range(40)]
                if (number, player) == (1, "b"):
                    moves = ["none"] * 40
                if (number, player) == (2, "b"):
                    moves[10:20] = ["unknown"] * 10
                for i, move in enumerate(moves):
                    rows.append((f"g{number}", f"{player}{number}", i, move, rng.choice(game.outcomes)))
        found[name] = Study.of(spark.createDataFrame(rows, ROUNDS), 1, game=game)
    return found


def by_grid(table, d, payoff, order):
    """Best responses and entropies of each context, from the table with every possible cell."""
    cells = defaultdict(lambda: defaultdict(dict))
    for r in table:
        cells[r.player_id][tuple(r[c] for c in d.context)][r[d.category[0]]] = r.p
    best, bits = {}, {}
    for player, found in cells.items():
        best[player] = {
            c: max(sum(p.get(o, 0.0) * x for o, x in zip(order, row)) for row in payoff) for c, p in found.items()
        }
        bits[player] = {c: -sum(x * math.log2(x) for x in p.values() if x > 0) for c, p in found.items()}
    return best, bits


@pytest.mark.parametrize("smoothing", [REFERENCE, LAPLACE])
@pytest.mark.parametrize("name", ["uneven", "four", "twenty"])
def test_sums_over_contexts_equal_those_of_the_whole_grid(studies, name, smoothing):
    study = studies[name]
    game, feats = study.game, study.features().cache()
    wcd = {
        r.player_id: r
        for r in player_expected_wcd(feats, game=game, game_rounds=1, smoothing=smoothing, alignment=ALIGNED).collect()
    }
    entropy = {r.player_id: r for r in entropies(feats, keys=GAME_KEYS, smoothing=smoothing, game=game).collect()}
    for which, d in dependencies(game).items():
        table = distribution(feats, d, GAME_KEYS, smoothing).collect()
        payoff = game.transition_payoff if d.of_transitions else game.payoff
        best, bits = by_grid(table, d, payoff, d.domain)
        for player, row in wcd.items():
            expected = sum(best[player].values()) / d.contexts if player in best else None
            assert row[EXPECTED_WCD[which]] == pytest.approx(expected, abs=1e-9), (which, player)
        if which not in WEIGHTED_BY:
            share = {p: {(): 1.0} for p in bits}
        else:
            weigh = contexts(game)[WEIGHTED_BY[which]]
            share = defaultdict(dict)
            for r in distribution(feats, weigh, GAME_KEYS).collect():
                share[r.player_id][tuple(r[c] for c in weigh.category)] = r.p
        for player, row in entropy.items():
            both = [c for c in bits.get(player, {}) if c in share.get(player, {})]
            expected = sum(bits[player][c] * share[player][c] for c in both) if both else None
            assert row[ENTROPY[which]] == pytest.approx(expected, abs=1e-9), (which, player)
    feats.unpersist()


@pytest.mark.parametrize("name", ["uneven", "four"])
def test_choices_as_rows_equal_choices_as_columns(studies, name):
    study = studies[name]
    tables = []
    for columns in (0, 8):
        best = best_responses(study.features(), game=study.game, choice_columns=columns)
        tables.append({tuple(r)[:5]: (r.n, r.max_util) for r in best.collect()})
    rows, columns = tables
    assert rows.keys() == columns.keys() and len(rows) > 50
    for key, (n, best) in rows.items():
        assert n == columns[key][0] and best == pytest.approx(columns[key][1], abs=1e-12)


def test_no_grid_is_made_for_twenty_choices(studies):
    study = studies["twenty"]
    for df in (player_expected_wcd(study.features(), game=TWENTY), entropies(study.features(), keys=GAME_KEYS, game=TWENTY)):
        text = df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        assert "transform(" not in text and "sequence(" not in text
        assert text.count("Exchange hashpartitioning") == 1
    # At most one row for each observed context, and one for all others.
    best = best_responses(study.features(), ["prev_2move"], game=TWENTY)
    assert best.count() <= 6 * 41 and best.filter("context_1 IS NULL").count() == 6


def test_steps_have_the_names_the_game_gives_them(spark):
    game = Game(FOUR.choices, FOUR.payoff, FOUR.cycle, ("up", "down", "stay", "across"), (1, -1, 0, 2))
    moves = [*game.cycle, "none", None]
    df = spark.createDataFrame([(a, b) for a in moves for b in moves], "a string, b string")
    named = df.select("a", "b", cyclic_transition("a", "b", game).alias("t"), cyclic_transition("a", "b", FOUR).alias("s"))
    for r in named.collect():
        if r.a in game.cycle and r.b in game.cycle:
            step = (game.cycle.index(r.b) - game.cycle.index(r.a)) % 4
            assert r.t == ("stay", "up", "across", "down")[step]
            assert r.s == ("0", "+", None, "-")[step]
        else:
            assert r.t == ("stay" if r.a == r.b == "none" else None)


@pytest.mark.parametrize(
    "wrong",
    [
        {"choices": ("rock", "rock", "paper")},
        {"choices": ("rock", "none", "paper")},
        {"cycle": ("rock", "well")},
        {"payoff": ((0.0, 1.0), (1.0, 0.0))},
        {"steps": (1, -2, 0)},
        {"transition_payoff": ((0.0,),)},
    ],
)
def test_a_game_that_does_not_fit_together_is_refused(wrong):
    with pytest.raises(ValueError):
        Game(**({"choices": RPS.choices, "payoff": RPS.payoff} | wrong))


def test_contexts_of_unequal_sizes():
    known = dependencies(FOUR)
    assert known["prev_2move"].contexts == 16 and known["outcome_transition"].contexts == 3
    assert known["prev_transition_prev_outcome"].contexts == 9 and known["move"].contexts == 1
    assert contexts(RPS) == CONTEXTS


@pytest.mark.parametrize("smoothing", [REFERENCE, LAPLACE])
def test_choices_do_not_multiply_the_rows_of_a_context(studies, smoothing):
    """summary_win_diff_twenty and _laplace: a row for each choice filled the memory of a task."""
    study = studies["twenty"]
    best = best_responses(study.features(), game=TWENTY, smoothing=smoothing)
    text = best._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "BroadcastExchange" not in text and "choice#" not in text
    # The same as a column for each choice.
    columns = best_responses(study.features(), game=TWENTY, smoothing=smoothing, choice_columns=20)
    want, got = ({tuple(r)[:5]: (r.n, r.max_util) for r in df.collect()} for df in (columns, best))
    assert want.keys() == got.keys() and len(want) > 100
    for key, (n, utility) in want.items():
        assert got[key][0] == n and got[key][1] == pytest.approx(utility, abs=1e-12), key


def test_observations_outside_the_choices_pay_nothing(spark):
    """A key whose moves are all unknown has contexts without any cell of the set."""
    rows = [("g", p, i, "unknown" if p == "a" else f"c{i % 20:02}", "tie") for p in "ab" for i in range(30)]
    study = Study.of(spark.createDataFrame(rows, ROUNDS), 1, game=TWENTY)
    want, got = (
        {tuple(r)[:5]: (r.n, r.max_util) for r in best_responses(study.features(), game=TWENTY, choice_columns=c).collect()}
        for c in (20, 8)
    )
    assert want.keys() == got.keys() and got["g", "a", 0, None, None] == (30, 0.0)
    for key, (n, utility) in want.items():
        assert got[key][0] == n and got[key][1] == pytest.approx(utility, abs=1e-12), key
