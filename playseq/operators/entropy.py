"""Shannon entropy of each dependency, weighted over contexts."""

from __future__ import annotations

from collections.abc import Sequence
from math import log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playseq.domain import PLAYER_KEYS, RPS, Game
from playseq.functions import entropy_term
from playseq.operators.distributions import (
    NOTHING,
    REFERENCE,
    SLOTS,
    contexts,
    count_cells,
    dependencies,
    in_domains,
    observed_probabilities,
)
from playseq.operators.sizes import LIMITS, Limits, spread

# The column each dependency's entropy goes by, in table order.
ENTROPY = {
    "move": "entropy_move_dist",
    "prev_move": "entropy_prev_move",
    "opponent_prev_move": "entropy_opponent_prev_move",
    "prev_2move": "entropy_prev_2move",
    "transition": "entropy_transition",
    "cournot_transition": "entropy_cournot_transition",
    "outcome_transition": "entropy_outcome_transition",
    "outcome_cournot_transition": "entropy_outcome_cournot_transition",
    "prev_transition_prev_outcome": "entropy_prev_transition_prev_outcome",
}

# Which context distribution weighs each conditional dependency.
WEIGHTED_BY = {
    "prev_move": "prev_move",
    "opponent_prev_move": "opponent_prev_move",
    "prev_2move": "prev_2move",
    "outcome_transition": "prev_outcome",
    "outcome_cournot_transition": "prev_outcome",
    "prev_transition_prev_outcome": "prev_transition_prev_outcome",
}


def entropies(
    df: DataFrame,
    names: Sequence[str] = tuple(ENTROPY),
    keys: Sequence[str] = PLAYER_KEYS,
    smoothing: str = REFERENCE,
    rows: int = 0,
    limits: Limits = LIMITS,
    game: Game = RPS,
) -> DataFrame:
    """Entropy in bits of each dependency, one column each.

    Conditional entropies weigh each context by how often it occurs on its own. A
    context without any conditional observation is left out, and the remaining
    weights are not rescaled; a smoothed one then has the entropy of uniform play. A key lacking a dependency altogether gets null. `rows` is
    the most counts there can be, if known.
    """
    targets = list(dict.fromkeys(WEIGHTED_BY[n] for n in names if n in WEIGHTED_BY))
    known = dependencies(game)
    chosen = [known[n] for n in names] + [contexts(game)[t] for t in targets]
    cells = count_cells(df, keys, chosen, NOTHING)
    if "game_id" not in keys:
        # One shuffle by key serves all the steps after counting. Keys within a game
        # need none: the feature table is already partitioned by game.
        cells = spread(cells, list(keys), rows, limits)
    cells = observed_probabilities(cells, keys, chosen, smoothing)

    # A context's share is stated under each dependency it weighs.
    stated_under = {i: [i] for i in range(len(names))} | {
        j: [i for i, n in enumerate(names) if WEIGHTED_BY.get(n) == target]
        for j, target in enumerate(targets, start=len(names))
    }
    cases = " ".join(
        f"WHEN {i} THEN array({', '.join(map(str, under))})" for i, under in stated_under.items()
    )
    is_share = f"distribution >= {len(names)}"
    stated = cells.select(
        *keys,
        F.expr(is_share).alias("is_share"),
        "p",
        "rest",
        *(
            F.expr(f"IF({is_share}, {category}, {context})").alias(context)
            for context, category in zip(SLOTS[:2], SLOTS[2:])
        ),
        F.explode(F.expr(f"CASE distribution {cases} END")).alias("dependency"),
    )
    smoothed = {i: known[n] for i, n in enumerate(names) if known[n].smoothed}
    bits = F.sum(F.when(~F.col("is_share"), entropy_term(F.col("p"))))
    if smoothed:
        # Categories never observed are all as likely as each other, and so in a context never observed.
        sizes = " ".join(f"WHEN {i} THEN {len(d.domain)}" for i, d in smoothed.items())
        uniform = " ".join(
            f"WHEN dependency = {i} AND {in_domains(d, category=False)} THEN {log2(len(d.domain))}D" for i, d in smoothed.items()
        )
        missing = F.expr(f"CASE dependency {sizes} END") - F.count(F.when(~F.col("is_share"), F.col("p")))
        rest = F.max("rest")
        bits = (
            F.when(rest.isNotNull(), F.coalesce(bits, F.lit(0.0)) + missing * entropy_term(rest))
            .when(F.count_if(~F.col("is_share")) > 0, bits)
            .otherwise(F.expr(f"CASE {uniform} END"))
        )
    by_context = stated.groupBy(*keys, "dependency", *SLOTS[:2]).agg(
        bits.alias("bits"),
        F.max(F.when(F.col("is_share"), F.col("p"))).alias("share"),
    )
    weighed = [str(i) for i, n in enumerate(names) if n in WEIGHTED_BY]
    weighted = F.col("bits")
    if weighed:
        weighted = F.expr(f"bits * IF(dependency IN ({', '.join(weighed)}), share, 1.0D)")
    # Only contexts with both an entropy and a share count.
    counted = by_context.select(*keys, "dependency", weighted.alias("bits")).filter(
        F.col("bits").isNotNull()
    )
    return counted.groupBy(*keys).agg(
        *(
            F.expr(f"sum(bits) FILTER (WHERE dependency = {i})").alias(ENTROPY[name])
            for i, name in enumerate(names)
        )
    )
