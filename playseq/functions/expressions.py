"""Column expressions used by the operators. All are built-in Spark expressions.

Columns are passed by name, so each expression is a single piece of SQL.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from playseq.domain import NO_MOVE, RPS, Game


def is_move(column: str) -> Column:
    """True for an actual move; false for a missing one or the no-move marker."""
    return F.expr(f"{column} IS NOT NULL AND {column} <> '{NO_MOVE}'")


def ordinal_sql(column: str, domain: Sequence[str]) -> str:
    """SQL for the position of a category in its domain, null outside it."""
    cases = " ".join(f"WHEN '{value}' THEN {i}" for i, value in enumerate(domain))
    return f"CASE {column} {cases} END"


def ordinal_of(column: str, domain: Sequence[str]) -> Column:
    """Position of a category in its domain, null outside it."""
    return F.expr(ordinal_sql(column, domain))


def label_of(column: str, labels: Mapping[str, object]) -> Column:
    """Recode a column through a small fixed mapping, null where there is no entry."""
    case = F
    for value, label in labels.items():
        case = case.when(F.col(column) == value, label)
    return case


def cyclic_transition(before: str, after: str, game: Game = RPS) -> Column:
    """Step from one move to the next around the cycle, by default "0" stay, "+" one up, "-" one down.

    Null when the two differ and either is not part of the cycle, or their step has no name.
    """
    size = len(game.cycle)
    step = f"pmod({ordinal_sql(after, game.cycle)} - {ordinal_sql(before, game.cycle)}, {size})"
    names = {places % size: name for places, name in zip(game.steps, game.transitions)}
    stay = f"'{names.pop(0)}'" if 0 in names else "CAST(NULL AS STRING)"
    moved = " ".join(f"WHEN {places} THEN '{name}'" for places, name in names.items())
    return F.expr(f"CASE WHEN {before} = {after} THEN {stay} ELSE CASE {step} {moved} END END")


def entropy_term(p: Column) -> Column:
    """One category's share of the Shannon entropy, in bits."""
    return F.when(p > 0, -p * F.log2(p)).otherwise(0.0)


def payoff_of_choice(p: str, position: str, payoffs: Sequence[float]) -> Column:
    """Summed payoff of one choice against categories at `position` having probability `p`.

    A category that is missing from the group counts as probability zero.
    """
    cases = " ".join(f"WHEN {i} THEN {float(value)}D" for i, value in enumerate(payoffs))
    return F.expr(f"sum({p} * CASE {position} {cases} ELSE 0.0D END)")
