"""Information gain of each dependency over uniform play, raw and corrected."""

from __future__ import annotations

from collections.abc import Sequence
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playseq.domain import GAME_KEYS, LABELLED_DEPENDENCIES, LABELS, PLAYER_KEYS, RPS, Game
from playseq.functions import label_of, ordinal_of
from playseq.operators.distributions import CELLS, REFERENCE, dependencies
from playseq.operators.entropy import ENTROPY, entropies
from playseq.plans.study import Study

UNCORRECTED, CORRECTED = "Uncorrected", "Corrected"
# Not reported, but needed to correct another dependency.
UNREPORTED = "outcome_cournot_transition"

# What is subtracted from each dependency's gain, in the order it is done. A name that
# was corrected further up stands for its corrected gain.
CORRECTIONS = {
    "opponent_prev_move": ("cournot_transition", "move"),
    "prev_move": ("transition", "move"),
    "outcome_transition": ("transition", "cournot_transition"),
    "outcome_cournot_transition": ("transition", "cournot_transition"),
    "prev_2move": ("prev_move", "transition", "move"),
    "prev_transition_prev_outcome": (
        "outcome_transition",
        "outcome_cournot_transition",
        "transition",
        "cournot_transition",
    ),
}

FIGURE_LABELS = {ENTROPY[name]: label for name, label in zip(LABELLED_DEPENDENCIES, LABELS)}


def player_entropies(
    study: Study, names: Sequence[str] = tuple(ENTROPY), smoothing: str = REFERENCE
) -> DataFrame:
    """The named entropies, over all games of every player who made at least one move."""
    # Where nobody plays twice, keys within the game are the same players, and their
    # counts can stay where the games are.
    keys = GAME_KEYS if study.sizes.games_per_player <= 1 else PLAYER_KEYS
    rows = study.sizes.rows * CELLS
    found = entropies(study.features(keys, CELLS), names, keys, smoothing, rows, study.limits, study.game)
    if "move" in names:
        found = found.filter(F.col(ENTROPY["move"]).isNotNull())
    return found.select("player_id", *(ENTROPY[name] for name in names))


def gains(player_entropies: DataFrame, game: Game = RPS) -> DataFrame:
    """Replace each entropy by its gain: the entropy of uniform play over its categories minus it."""
    known = dependencies(game)
    return player_entropies.withColumns(
        {c: F.lit(log2(len(known[name].domain))) - F.col(c) for name, c in ENTROPY.items()}
    )


def corrected_gains(gains: DataFrame) -> DataFrame:
    """Take the gain already explained by simpler dependencies off the composed ones."""
    # One step per correction: later ones read what earlier ones wrote.
    for name, simpler in CORRECTIONS.items():
        remaining: Column = F.col(ENTROPY[name])
        for other in simpler:
            remaining = remaining - F.col(ENTROPY[other])
        gains = gains.withColumn(ENTROPY[name], remaining)
    return gains


def _long(wide: DataFrame, columns: dict[tuple[str, str], str]) -> DataFrame:
    rows = [
        F.struct(
            F.lit(entropy_type).alias("entropy_type"),
            F.col(column).alias("information_gain"),
            F.lit(corrected).alias("corrected"),
        )
        for (entropy_type, corrected), column in columns.items()
    ]
    return wide.select("player_id", F.inline(F.array(*rows)))


def _reported(corrected: str, prefix: str = "") -> dict[tuple[str, str], str]:
    return {(c, corrected): prefix + c for n, c in ENTROPY.items() if n != UNREPORTED}


def information_gain_uncorrected(player_entropies: DataFrame, game: Game = RPS) -> DataFrame:
    return _long(gains(player_entropies, game), _reported(UNCORRECTED))


def information_gain_corrected(player_entropies: DataFrame, game: Game = RPS) -> DataFrame:
    return _long(corrected_gains(gains(player_entropies, game)), _reported(CORRECTED))


def information_gain_combined(player_entropies: DataFrame, game: Game = RPS) -> DataFrame:
    """Both tables in one, from a single pass over the players."""
    raw = gains(player_entropies, game)
    kept = raw.withColumns({f"raw_{c}": F.col(c) for c in ENTROPY.values()})
    return _long(corrected_gains(kept), _reported(UNCORRECTED, "raw_") | _reported(CORRECTED))


def information_gain_summary(combined: DataFrame, null_policy: str = "propagate") -> DataFrame:
    """Mean and standard error over players, by correction and dependency.

    With "propagate" a single player lacking a value makes both null; "skip" leaves
    such players out. `combined` has one row per player within each group.
    """
    if null_policy not in ("propagate", "skip"):
        raise ValueError(f"null_policy must be 'propagate' or 'skip', not {null_policy!r}")
    value = F.col("information_gain")
    players = F.count("*")
    mean, error = F.avg(value), F.stddev_samp(value) / F.sqrt(players)
    if null_policy == "propagate":
        whole = F.count(value) == players
        mean, error = F.when(whole, mean), F.when(whole, error)
    return combined.groupBy("corrected", "entropy_type").agg(
        mean.alias("mean_information_gain"), error.alias("se_information_gain")
    )


def information_gain_figure(summary: DataFrame) -> DataFrame:
    """The summary with display labels, their order, and one standard error to each side."""
    mean, error = F.col("mean_information_gain"), F.col("se_information_gain")
    return summary.select(
        label_of("entropy_type", FIGURE_LABELS).alias("entropy_type"),
        ordinal_of("entropy_type", tuple(FIGURE_LABELS)).alias("ordinal"),
        "corrected",
        "mean_information_gain",
        (mean - error).alias("lower"),
        (mean + error).alias("upper"),
    )
