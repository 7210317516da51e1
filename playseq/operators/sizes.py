"""Group sizes of a rounds table, measured in one job before a plan is chosen."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playseq.domain import MIN_ROUNDS
from playseq.operators.sequence import checkpoint


@dataclass(frozen=True)
class Limits:
    """What one task, one block of rounds and one broadcast may hold, and how wide a shuffle may be."""

    rows_per_task: int = 8_000_000
    rounds_per_block: int = 131_072
    broadcast_rows: int = 1_000_000
    partitions: int = 50_000

    def tasks_for(self, rows: int) -> int:
        """Partitions that leave room in each task for keys that hash together."""
        return min(self.partitions, math.ceil(2 * rows / self.rows_per_task))


LIMITS = Limits()
# Rows that one task can't take are dealt to this many at least, or to the session's default if that is less.
WIDTH = 32


@dataclass(frozen=True)
class Sizes:
    rows: int
    rows_per_game: int
    rows_per_sequence: int  # one player within one game
    rows_per_player: int
    players_per_game: int
    games_per_player: int
    blocks_per_sequence: int
    incomplete_players: int
    unnumbered_per_game: int = 0  # rounds whose number is unknown
    #: Ids of the incomplete players, read from the measured aggregate; absent if there are none.
    incomplete: DataFrame | None = field(default=None, compare=False)


def measure(rounds: DataFrame, min_rounds: int = MIN_ROUNDS, limits: Limits = LIMITS) -> Sizes:
    """Measure the largest groups; reads three columns and collects two rows.

    The aggregate behind it, one small row for each player and game, is checkpointed, so that
    the incomplete players don't derive the rounds again.
    Rows are counted per player and game before anything is shuffled, so a game or
    player holding most of the table costs no more here than any other. Sizes of a
    table bound the sizes of any subset of it.
    """
    block = F.floor(F.col("round_index") / limits.rounds_per_block)
    sequences = checkpoint(rounds.groupBy("game_id", "player_id").agg(
        F.count("*").alias("rows"),
        F.max("round_index").alias("last"),
        F.count_if(F.col("round_index").isNull()).alias("unknown"),
        F.coalesce(F.max(block) - F.min(block) + 1, F.lit(1)).alias("blocks"),
    ))
    # One pass over the sequences gives both the games and the players.
    groups = sequences.groupingSets(
        [["game_id"], ["player_id"]], "game_id", "player_id"
    ).agg(
        F.grouping("player_id").alias("is_game"),
        F.sum("rows").alias("rows"),
        F.count("*").alias("members"),
        F.max("rows").alias("sequence"),
        F.max("blocks").alias("blocks"),
        F.sum("unknown").alias("unnumbered"),
        ((F.max("last") < min_rounds) & (F.sum("unknown") == 0)).alias("is_incomplete"),
    )
    found = {
        row["is_game"]: row
        for row in groups.groupBy("is_game")
        .agg(
            F.sum("rows").alias("total"),
            *(F.max(c).alias(c) for c in ("rows", "members", "sequence", "blocks", "unnumbered")),
            F.count_if("is_incomplete").alias("incomplete"),
        )
        .collect()
    }
    if not found:
        return Sizes(0, 0, 0, 0, 0, 0, 0, 0)
    game, player = found[1], found[0]
    incomplete = None
    if player["incomplete"]:
        incomplete = (
            sequences.groupBy("player_id")
            .agg(F.max("last").alias("last"), F.sum("unknown").alias("unknown"))
            .filter((F.col("last") < min_rounds) & (F.col("unknown") == 0))
            .select(F.col("player_id").alias("incomplete_id"))
        )
    return Sizes(
        rows=game["total"],
        rows_per_game=game["rows"],
        rows_per_sequence=game["sequence"],
        rows_per_player=player["rows"],
        players_per_game=game["members"],
        games_per_player=player["members"],
        blocks_per_sequence=game["blocks"],
        incomplete_players=player["incomplete"],
        unnumbered_per_game=game["unnumbered"],
        incomplete=incomplete,
    )


def spread(df: DataFrame, columns: list[str], rows: int, limits: Limits = LIMITS) -> DataFrame:
    """Hash-partition by columns; rows that need more than one task get a fixed number of partitions.

    Otherwise adaptive execution merges partitions by their bytes, which don't tell what the rows become
    in the task.
    """
    needed = limits.tasks_for(rows)
    if needed <= 1:
        return df.repartition(*columns)
    least = min(WIDTH, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(max(needed, least), *columns)
