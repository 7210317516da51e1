"""Derive a rounds table from an event log: users 2k and 2k+1 play each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playseq.domain import NO_MOVE, RPS, Game
from playseq.functions import label_of
from playseq.operators.sequence import group_sizes, number_rows
from playseq.operators.sizes import LIMITS, Limits, spread

# The move each event type stands for.
EVENT_MOVES = {
    "click": "rock",
    "signup": "rock",
    "view": "paper",
    "purchase": "scissors",
    "error": NO_MOVE,
}


# Room for every game number of a pair: round numbers are 32-bit.
GAMES_PER_PAIR = 2**31


def _outcome(own: str, other: str, game: Game) -> Column:
    """Result for the owner of the first move, by the sign of its payoff; null when there is no opponent."""
    win, loss, tie = game.outcomes

    def pays(worth) -> Column:
        found = F.lit(False)
        for choice, row in zip(game.choices, game.payoff):
            against = [c for c, value in zip(game.choices, row) if worth(value)]
            if against:
                found = found | ((F.col(own) == choice) & F.col(other).isin(against))
        return found

    return (
        F.when(F.col(own) == F.col(other), tie)
        .when(F.col(other).isNull(), None)
        .when(F.col(own) == NO_MOVE, loss)
        .when(F.col(other) == NO_MOVE, win)
        .when(pays(lambda value: value > 0), win)
        .when(pays(lambda value: value == 0), tie)
        .otherwise(loss)
    )


def rounds_from_events(
    events: DataFrame,
    *,
    paired: bool = False,
    rounds_per_game: int | None = None,
    by_game: bool = True,
    cells: int = 1,
    limits: Limits = LIMITS,
    game: Game = RPS,
    move: Column | None = None,
) -> DataFrame:
    """One row per event; `paired` keeps only rounds that both players reached.

    With `rounds_per_game` a pair's rounds are cut into consecutive games, so each
    player takes part in several. `by_game` deals the rounds to tasks by game, which all windows
    within games then share and which hold `cells` rows for each round; without it, what only counts
    moves can combine before any shuffle. `move` is the choice an event stands for, by default that of its
    type; `game` decides the outcomes.
    """
    rows, largest = group_sizes(events, ["user_id"])
    slices = limits.tasks_for(rows) if largest > limits.rows_per_task else 0

    moves = events.select(
        F.expr("user_id div 2").alias("game_id"),
        F.col("user_id").alias("player_id"),
        "ts",
        "event_id",
        (label_of("event_type", EVENT_MOVES) if move is None else move).alias("player_move"),
    )
    if by_game and not slices:
        # A game is then two small users, so numbering, pairing and any later
        # windows within games share this one shuffle.
        moves = spread(moves, ["game_id"], rows * cells, limits)
    numbered = number_rows(
        moves, ["game_id", "player_id"], ["ts", "event_id"], "round_index", range_count=slices
    ).withColumn("round_index", F.col("round_index").cast("int"))
    if rounds_per_game:
        start = F.col("round_index") - 1
        numbered = numbered.select(
            (F.col("game_id") * GAMES_PER_PAIR + F.floor(start / rounds_per_game)).alias("game_id"),
            "player_id",
            (start % rounds_per_game + 1).alias("round_index"),
            "player_move",
        )

    # At most two rows share a round: a game has two users and numbers are unique per user.
    pair = Window.partitionBy("game_id", "round_index").orderBy("player_id")
    neighbour = F.struct("player_move")
    other = F.coalesce(F.lag(neighbour).over(pair), F.lead(neighbour).over(pair))
    rounds = numbered.select("game_id", "player_id", "round_index", "player_move", other.alias("other"))
    if paired:
        # The opponent's row counts, whatever its move.
        rounds = rounds.filter(F.col("other").isNotNull())
    rounds = rounds.withColumn("other_move", F.col("other.player_move"))
    return rounds.select(
        "game_id",
        "player_id",
        "round_index",
        "player_move",
        _outcome("player_move", "other_move", game).alias("player_outcome"),
    )
