"""What an opponent who exploits a dependency could win by, and what was really won."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playseq.domain import GAME_KEYS, GAME_ROUNDS, RPS, Game
from playseq.functions import payoff_of_choice
from playseq.functions.expressions import ordinal_sql
from playseq.operators.distributions import (
    DEPENDENCIES,
    MARK,
    REFERENCE,
    SLOTS,
    Distribution,
    count_cells,
    dependencies,
    observed_probabilities,
    wins,
)
from playseq.operators.sequence import shift
from playseq.operators.sizes import LIMITS, Limits, Sizes, measure

POSITIONAL, ALIGNED = "positional", "aligned"
# Up to this many choices each has a column of its own; more are summed over lists of cells.
CHOICE_COLUMNS = 8

# The per-game column each dependency's expected differential goes by.
EXPECTED_WCD = {
    "move": "max_exp_wcd_move_dist",
    "transition": "max_exp_wcd_transition",
    "cournot_transition": "max_exp_wcd_transition_cournot",
    "opponent_prev_move": "max_exp_wcd_opponent_prev_move",
    "prev_move": "max_exp_wcd_player_prev_move",
    "outcome_transition": "max_exp_wcd_transition_outcome",
    "outcome_cournot_transition": "max_exp_wcd_cournot_transition_outcome",
    "prev_2move": "max_exp_wcd_player_prev_2move",
    "prev_transition_prev_outcome": "max_exp_wcd_transition_prev_transition_prev_outcome",
}


def payoff_columns(d: Distribution, alignment: str) -> tuple[str, ...]:
    """The category each payoff column is taken to stand for.

    "aligned" follows the category domain. "positional" follows the row order of the
    distribution table: the domain for the plain move distribution, byte order otherwise.
    """
    if alignment not in (POSITIONAL, ALIGNED):
        raise ValueError(f"alignment must be {POSITIONAL!r} or {ALIGNED!r}, not {alignment!r}")
    if alignment == ALIGNED or (not d.context and d.category == ("player_move",)):
        return d.domain
    return tuple(sorted(d.domain))


def best_responses(
    df: DataFrame,
    names: Sequence[str] = tuple(DEPENDENCIES),
    keys: Sequence[str] = GAME_KEYS,
    *,
    game: Game = RPS,
    alignment: str = POSITIONAL,
    smoothing: str = REFERENCE,
    also: Sequence[Distribution] = (),
    choice_columns: int = CHOICE_COLUMNS,
) -> DataFrame:
    """Best expected payoff per round against each key, dependency and observed context.

    Smoothed dependencies also have a row without a context, which holds for every context never
    observed. `n` counts the observations. Distributions in `also` are counted in the same pass.
    Probabilities of categories never observed enter through the sum of a choice's payoffs, so the
    work goes by what was observed, however many contexts are possible.
    """
    known = dependencies(game)
    chosen = [known[name] for name in names]
    counted = [*chosen, *also]
    cells = observed_probabilities(count_cells(df, keys, counted, MARK), keys, counted, smoothing)
    # Positions of transitions follow those of choices.
    first = len(game.choices)
    orders: dict[tuple[int, tuple[str, ...]], list[str]] = {}
    for i, d in enumerate(chosen):
        start = first if d.of_transitions else 0
        orders.setdefault((start, payoff_columns(d, alignment)), []).append(str(i))
    members: dict[int, list[str]] = {}
    for (start, _), found in orders.items():
        members.setdefault(start, []).extend(found)
    positions = " ".join(
        f"WHEN distribution IN ({', '.join(found)}) THEN {start} + {ordinal_sql('category_1', columns)}"
        for (start, columns), found in orders.items()
    )
    weighed = cells.withColumns(
        {
            "position": F.expr(f"CASE {positions} END"),
            "weight": F.expr("coalesce(p - coalesce(rest, 0.0D), 0.0D)"),
        }
    )
    payoffs = {start: game.transition_payoff if start else game.payoff for start in members}
    groups = [*keys, "distribution", *SLOTS[:2]]
    if max(map(len, payoffs.values())) > choice_columns:
        return _best_of_lists(weighed, groups, payoffs, members, first)
    return _best_of_columns(weighed, groups, payoffs, members, first)


def _best_of_columns(weighed, groups, payoffs, members, first) -> DataFrame:
    """The best choice, each of them summed in a column."""
    choices = [f"choice_{i}" for i in range(max(map(len, payoffs.values())))]

    def utility(i: int) -> Column:
        having = {start: table[i] for start, table in payoffs.items() if i < len(table)}
        by_position = [0.0] * (first + max(map(len, having.values())))
        for start, row in having.items():
            by_position[start : start + len(row)] = row
        whole = " ".join(
            f"WHEN distribution IN ({', '.join(members[start])}) THEN {float(sum(row))}D" for start, row in having.items()
        )
        # No value for dependencies that have fewer choices.
        known = F.expr(f"CASE {whole} END")
        return payoff_of_choice("weight", "position", by_position) + known * F.coalesce(F.max("rest"), F.lit(0.0))

    return (
        weighed.groupBy(*groups)
        .agg(*(utility(i).alias(choice) for i, choice in enumerate(choices)), F.sum("n").alias("n"))
        .select(*groups, "n", F.greatest(*choices).alias("max_util"))
    )


def _best_of_lists(weighed, groups, payoffs, members, first) -> DataFrame:
    """The best choice, each of them summed over the list of a context's cells.

    A context becomes one row, whatever the number of choices, and its list has a cell for each observed
    category of the set at most. The payoff table, the square of the number of choices, is a parameter.
    """
    # The sum of a choice's payoffs stands behind them and is weighed by `rest`.
    tables, ends = [], []
    for start, table in payoffs.items():
        rows = ", ".join(f"array({', '.join(f'{float(value)}D' for value in (*row, sum(row)))})" for row in table)
        having = f"WHEN distribution IN ({', '.join(members[start])})"
        tables.append(f"{having} THEN array({rows})")
        ends.append(f"{having} THEN {len(table)}")
    listed = f"collect_list(named_struct('at', position - IF(position < {first}, 0, {first}), 'weight', weight))"
    return (
        weighed.groupBy(*groups)
        .agg(
            # What has no category in the set pays nothing.
            F.expr(f"{listed} FILTER (WHERE position IS NOT NULL)").alias("cells"),
            F.expr("coalesce(max(rest), 0.0D)").alias("rest"),
            F.sum("n").alias("n"),
        )
        .withColumn("cells", F.expr(f"concat(cells, array(named_struct('at', CASE {' '.join(ends)} END, 'weight', rest)))"))
        .select(
            *groups,
            "n",
            # No value for distributions that have no payoff.
            F.expr(
                f"aggregate(CASE {' '.join(tables)} END, CAST(NULL AS DOUBLE), (best, payoff) -> greatest(best,"
                " aggregate(cells, 0.0D, (s, cell) -> s + cell.weight * payoff[cell.at])))"
            ).alias("max_util"),
        )
    )


def player_expected_wcd(
    df: DataFrame,
    names: Sequence[str] = tuple(DEPENDENCIES),
    keys: Sequence[str] = GAME_KEYS,
    *,
    game: Game = RPS,
    game_rounds: int = GAME_ROUNDS,
    weights: Mapping[str, float] | None = None,
    with_wins: bool = False,
    **options,
) -> DataFrame:
    """Expected win-count differential against each key, one column per dependency.

    Contexts weigh the same, one over the number of possible contexts, unless
    `weights` names another factor; contexts that never occur add nothing, but those of smoothed
    dependencies what uniform play is worth.
    `with_wins` adds `n_wins`, the rounds each key won, null for none.
    """
    best = best_responses(df, names, keys, game=game, also=[wins(game)] if with_wins else [], **options)
    known = dependencies(game)
    factors = {name: 1 / known[name].contexts for name in names} | dict(weights or {})
    return best.groupBy(*keys).agg(
        *(
            F.expr(f"({_over_contexts(i, known[name], game)}) * {factors[name] * game_rounds}D").alias(
                EXPECTED_WCD[name]
            )
            for i, name in enumerate(names)
        ),
        *[F.expr(f"sum(n) FILTER (WHERE distribution = {len(names)})").alias("n_wins")] * with_wins,
    )


def _over_contexts(index: int, d: Distribution, game: Game) -> str:
    """SQL for the sum of best payoffs over all contexts, those never observed included if smoothed."""
    payoff = game.transition_payoff if d.of_transitions else game.payoff
    unseen = max(sum(row) for row in payoff) / len(d.domain) if d.smoothed else 0.0
    if not unseen:
        return f"sum(max_util) FILTER (WHERE distribution = {index})"
    # The row that stands for contexts never observed holds just this payoff.
    return f"sum(max_util - {unseen}D) FILTER (WHERE distribution = {index}) + {unseen * d.contexts}D"


def expected_wcd(df: DataFrame, names: Sequence[str] = tuple(DEPENDENCIES), **options) -> DataFrame:
    """Expected win-count differential of each game: the mean over its players."""
    players = player_expected_wcd(df, names, GAME_KEYS, **options)
    columns = [EXPECTED_WCD[name] for name in names]
    return players.groupBy("game_id").agg(*(F.avg(c).alias(c) for c in columns))


def empirical_wcd(
    rounds: DataFrame, sizes: Sizes | None = None, limits: Limits = LIMITS, game: Game = RPS
) -> DataFrame:
    """Difference in wins between the players of each game.

    Players without a win are left out, and with them games that keep fewer than two players.
    """
    sizes = sizes or measure(rounds, limits=limits)
    winners = (
        rounds.groupBy("game_id", "player_id")
        .agg(F.count_if(F.col("player_outcome") == game.outcomes[0]).alias("n_wins"))
        .filter("n_wins > 0")
    )
    slices = 0 if sizes.players_per_game <= limits.rows_per_task else limits.tasks_for(sizes.rows)
    both = shift(
        winners, ["game_id"], ["player_id"], {"opponent_wins": ("n_wins", 1)}, range_count=slices
    )
    return both.filter(F.col("opponent_wins").isNotNull()).select("game_id", _difference())


def _difference() -> Column:
    return F.abs(F.col("n_wins") - F.col("opponent_wins")).alias("empirical_wcd")


def expected_and_empirical_wcd(df: DataFrame, **options) -> DataFrame:
    """All expected differentials of each game beside the empirical one.

    The same rows as joining `expected_wcd` with `empirical_wcd`, but from a single
    count of the feature table. The players of a game are windowed together, so
    their number must be small, as it is by contract.
    """
    columns = list(EXPECTED_WCD.values())
    game = Window.partitionBy("game_id")
    # Players without a win form a window of their own, so none stands between two winners.
    winners = Window.partitionBy("game_id", F.col("n_wins").isNull()).orderBy("player_id")
    players = player_expected_wcd(df, list(EXPECTED_WCD), GAME_KEYS, with_wins=True, **options)
    return players.select(
        "game_id",
        "n_wins",
        F.lag("n_wins").over(winners).alias("opponent_wins"),
        *(F.avg(c).over(game).alias(c) for c in columns),
    ).filter("opponent_wins IS NOT NULL").select("game_id", _difference(), *columns)
