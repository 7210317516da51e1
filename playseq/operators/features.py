"""Per-round features: previous moves and outcome, opponent's previous move, transitions.

All lags are taken over every round before any filter, so a round without a move
still occupies its place in the sequence.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playseq.domain import GAME_KEYS, PLAYER_KEYS, RPS, Game
from playseq.functions import cyclic_transition, is_move
from playseq.operators.sequence import shift
from playseq.operators.sizes import LIMITS, Limits, Sizes, measure, spread

BLOCK = "_block"
# Puts rows that share a player and a round in an order that doesn't depend on how they were read.
TIES = ("prev_move", "prev_move2", "prev_outcome", "player_move", "player_outcome")


def follows(keys: Sequence[str]) -> str:
    """The column that is true except on the first row of each sequence of these keys."""
    return f"follows_in_{'_'.join(keys)}"


def features(
    rounds: DataFrame,
    keys: Sequence[str] = GAME_KEYS,
    sizes: Sizes | None = None,
    limits: Limits = LIMITS,
    game: Game = RPS,
) -> DataFrame:
    """Add every lagged and derived column; unused ones are pruned by the optimizer.

    `keys` is what one sequence of moves belongs to: a player in a game, ordered by
    round, or a player over all games, ordered by game and round.
    """
    keys = tuple(keys)
    if keys not in (GAME_KEYS, PLAYER_KEYS):
        raise ValueError(f"keys must be {GAME_KEYS} or {PLAYER_KEYS}, not {keys}")
    sizes = sizes or measure(rounds, limits=limits)
    lagged = with_lags(rounds, keys, sizes, limits)
    return with_transitions(with_opponent(lagged, sizes, limits), game)


def with_lags(rounds: DataFrame, keys: tuple[str, ...], sizes: Sizes, limits: Limits) -> DataFrame:
    """Previous move, the one before it, and previous outcome of each sequence."""
    outputs = {
        "prev_move": ("player_move", 1),
        "prev_move2": ("player_move", 2),
        "prev_outcome": ("player_outcome", 1),
        follows(keys): (F.lit(True), 1),
    }
    if keys == PLAYER_KEYS and sizes.games_per_player <= 1:
        # Nobody plays twice, so a player's sequence is that of their only game.
        keys = GAME_KEYS
        outputs[follows(keys)] = (F.lit(True), 1)

    order = ["round_index"] if keys == GAME_KEYS else ["game_id", "round_index"]
    if sizes.unnumbered_per_game > limits.rows_per_task:
        # Rounds without a number fall into no block, so the sequence is cut by range.
        return shift(rounds, keys, order, outputs, range_count=limits.tasks_for(sizes.rows))

    blocks = rounds.withColumn(BLOCK, F.floor(F.col("round_index") / limits.rounds_per_block))
    if keys == GAME_KEYS:
        if sizes.rows_per_game <= limits.rows_per_task:
            return shift(spread(rounds, ["game_id"], sizes.rows, limits), keys, order, outputs)
        if sizes.rows_per_sequence <= limits.rows_per_task:
            return shift(spread(rounds, list(keys), sizes.rows, limits), keys, order, outputs)
        # Round numbers are 32-bit and unique in a sequence, so blocks and their number are bounded.
        near = spread(blocks, [*keys, BLOCK], sizes.rows, limits)
        return shift(near, keys, order, outputs, slice_by=[BLOCK]).drop(BLOCK)

    if sizes.rows_per_player <= limits.rows_per_task:
        return shift(spread(rounds, ["player_id"], sizes.rows, limits), keys, order, outputs)
    edges_per_player = 4 * sizes.games_per_player * sizes.blocks_per_sequence
    edge_slices = 0 if edges_per_player <= limits.rows_per_task else limits.tasks_for(sizes.rows)
    if sizes.rows_per_sequence <= limits.rows_per_task:
        near = spread(rounds, ["player_id", "game_id"], sizes.rows, limits)
        return shift(near, keys, order, outputs, slice_by=["game_id"], range_count=edge_slices)
    near = spread(blocks, ["player_id", "game_id", BLOCK], sizes.rows, limits)
    return shift(near, keys, order, outputs, slice_by=["game_id", BLOCK], range_count=edge_slices).drop(BLOCK)


def with_opponent(lagged: DataFrame, sizes: Sizes, limits: Limits) -> DataFrame:
    """The opponent's previous move, in the two populations the analyses use.

    `opponent_prev_move` pairs all rounds that have a predecessor.
    `opponent_prev_move_both` pairs only rounds where the player has a previous
    outcome, a previous move and a move, so both players must have them.
    """
    if sizes.rows_per_game <= limits.rows_per_task:
        near = spread(lagged, ["game_id"], sizes.rows, limits)
    else:
        near = spread(lagged, ["game_id", "round_index"], sizes.rows, limits)
    everything = F.col("prev_move").isNotNull()
    complete = (
        F.col("prev_outcome").isNotNull() & is_move("prev_move") & is_move("player_move")
    )
    near = _pair(near, "opponent_prev_move", everything, sizes, limits)
    return _pair(near, "opponent_prev_move_both", complete, sizes, limits)


def _pair(df: DataFrame, name: str, included: Column, sizes: Sizes, limits: Limits) -> DataFrame:
    """Each included row's neighbour in its round: the row before it, or after for the first row."""
    columns = df.columns
    # The flag joins the key, so excluded rows never stand between included ones.
    flagged = df.withColumn("_included", F.coalesce(included, F.lit(False)))
    # Rounds of a game without a number are one round here, however many they are.
    largest = max(sizes.players_per_game, sizes.unnumbered_per_game)
    slices = 0 if largest <= limits.rows_per_task else limits.tasks_for(sizes.rows)
    neighbours = shift(
        flagged,
        ["game_id", "round_index", "_included"],
        ["player_id", *TIES],
        {
            "_move_above": ("player_move", 1),
            "_prev_above": ("prev_move", 1),
            "_prev_below": ("prev_move", -1),
        },
        range_count=slices,
    )
    other = F.when(F.col("_move_above").isNull(), F.col("_prev_below")).otherwise(F.col("_prev_above"))
    return neighbours.select(*columns, F.when(F.col("_included"), other).alias(name))


def with_transitions(df: DataFrame, game: Game = RPS) -> DataFrame:
    """Own and opponent-relative transitions, by the names the game gives them."""
    return df.withColumns(
        {
            "transition": cyclic_transition("prev_move", "player_move", game),
            "prev_transition": cyclic_transition("prev_move2", "prev_move", game),
            "cournot_transition": cyclic_transition("opponent_prev_move", "player_move", game),
            "cournot_transition_both": cyclic_transition("opponent_prev_move_both", "player_move", game),
        }
    )
