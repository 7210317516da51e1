"""Common start of both analyses: complete players, measured once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from playseq.domain import GAME_KEYS, MIN_ROUNDS, RPS, Game
from playseq.operators.features import features
from playseq.operators.sizes import LIMITS, Limits, Sizes, measure
from playseq.sources.tables import complete_rounds


@dataclass(frozen=True)
class Study:
    """Rounds of complete players, with the group sizes that decide how they are processed."""

    rounds: DataFrame
    sizes: Sizes
    limits: Limits = LIMITS
    game: Game = RPS

    @classmethod
    def of(
        cls, rounds: DataFrame, min_rounds: int = MIN_ROUNDS, limits: Limits = LIMITS, game: Game = RPS
    ) -> Study:
        sizes = measure(rounds, min_rounds, limits)
        return cls(complete_rounds(rounds, min_rounds, sizes, limits), sizes, limits, game)

    def features(self, keys: Sequence[str] = GAME_KEYS, cells: int = 1) -> DataFrame:
        """The feature table, dealt to tasks that can hold `cells` rows for each round."""
        sizes = replace(self.sizes, rows=self.sizes.rows * cells)
        return features(self.rounds, keys, sizes, self.limits, self.game)
