"""Marginal and conditional category distributions of each sequence.

Any number of distributions is counted in one pass: every round emits one cell for
each distribution it belongs to, and cells are counted per key. Counts are combined
before the shuffle, so a key contributes at most its number of distinct cells to it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from math import prod

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playseq.domain import GAME_KEYS, NO_MOVE, RPS, Game
from playseq.operators.features import follows

REFERENCE, LAPLACE = "reference", "laplace"


@dataclass(frozen=True)
class Distribution:
    """What is counted, within which context, over which rounds."""

    name: str
    category: tuple[str, ...]
    context: tuple[str, ...] = ()
    moves: tuple[str, ...] = ()  # columns that must hold an actual move
    present: tuple[str, ...] = ()  # columns that must not be null
    equal: tuple[tuple[str, str], ...] = ()  # columns that must have a value
    smoothed: bool = False
    domain: tuple[str, ...] = ()
    context_domains: tuple[tuple[str, ...], ...] = ()

    def of(self, game: Game) -> Distribution:
        """The same distribution over the category sets of a game."""
        return replace(
            self,
            domain=game.values_of(self.category[0]),
            context_domains=tuple(game.values_of(c) for c in self.context),
        )

    @property
    def of_transitions(self) -> bool:
        return "transition" in self.category[0]

    @property
    def contexts(self) -> int:
        """Number of possible contexts."""
        return prod(len(values) for values in self.context_domains)

    def included(self) -> str:
        """SQL condition for a round to count; a missing move fails it like the no-move marker."""
        return " AND ".join(
            [
                *(f"{c} <> '{NO_MOVE}'" for c in self.moves),
                *(f"{c} IS NOT NULL" for c in self.present),
                *(f"{c} = '{value}'" for c, value in self.equal),
            ]
        )


def _index(*distributions: Distribution) -> dict[str, Distribution]:
    return {d.name: d.of(RPS) for d in distributions}


# The nine dependencies both analyses estimate.
DEPENDENCIES = _index(
    Distribution("move", ("player_move",), moves=("player_move",)),
    Distribution(
        "transition", ("transition",), moves=("prev_move", "player_move")
    ),
    Distribution(
        "cournot_transition",
        ("cournot_transition",),
        moves=("opponent_prev_move", "player_move"),
    ),
    Distribution(
        "prev_move", ("player_move",), ("prev_move",), moves=("player_move", "prev_move")
    ),
    Distribution(
        "opponent_prev_move",
        ("player_move",),
        ("opponent_prev_move",),
        moves=("player_move", "opponent_prev_move"),
    ),
    Distribution(
        "outcome_transition",
        ("transition",),
        ("prev_outcome",),
        moves=("prev_move", "player_move"),
        present=("prev_outcome",),
    ),
    Distribution(
        "outcome_cournot_transition",
        ("cournot_transition_both",),
        ("prev_outcome",),
        moves=("opponent_prev_move_both", "player_move"),
    ),
    Distribution(
        "prev_2move",
        ("player_move",),
        ("prev_move", "prev_move2"),
        moves=("player_move", "prev_move", "prev_move2"),
        smoothed=True,
    ),
    Distribution(
        "prev_transition_prev_outcome",
        ("transition",),
        ("prev_transition", "prev_outcome"),
        moves=("player_move", "prev_move", "prev_move2"),
        present=("prev_outcome",),
        smoothed=True,
    ),
)

# How often each context occurs. These admit more rounds than the conditional
# distributions above: the current move may be missing.
CONTEXTS = _index(
    Distribution("prev_move", ("prev_move",), moves=("prev_move",)),
    Distribution(
        "opponent_prev_move",
        ("opponent_prev_move",),
        moves=("opponent_prev_move",),
        present=("prev_move",),
    ),
    Distribution("prev_outcome", ("prev_outcome",), present=("prev_outcome",)),
    Distribution("prev_2move", ("prev_move", "prev_move2"), moves=("prev_move", "prev_move2")),
    Distribution(
        "prev_transition_prev_outcome",
        ("prev_transition", "prev_outcome"),
        moves=("prev_move2", "prev_move", "player_move"),
        present=("prev_outcome",),
    ),
)


def dependencies(game: Game) -> dict[str, Distribution]:
    return {name: d.of(game) for name, d in DEPENDENCIES.items()}


def contexts(game: Game) -> dict[str, Distribution]:
    return {name: d.of(game) for name, d in CONTEXTS.items()}


# Rows that a task holds for each round where all dependencies are counted: a cell of each and one of the
# wins, in about four steps (counts combined, counts, sorted for the totals, best responses or entropies).
CELLS = 4 * (len(DEPENDENCIES) + 1)


# Rounds won, counted along with the others where both are needed.
def wins(game: Game) -> Distribution:
    return Distribution("wins", ("player_outcome",), equal=(("player_outcome", game.outcomes[0]),)).of(game)


# What count_cells adds for smoothed distributions: every cell of the grid, one mark for each sequence
# (a cell without context or category), or nothing.
GRID, MARK, NOTHING = "grid", "mark", "nothing"

# A cell's place: at most two context columns and two category columns.
SLOTS = ("context_1", "context_2", "category_1", "category_2")


def _cell(index: int, weight: int, context: Sequence[str], category: Sequence[str]) -> str:
    """SQL for one cell; context and category are SQL expressions."""
    absent = "CAST(NULL AS STRING)"
    values = [*context, *[absent] * (2 - len(context)), *category, *[absent] * (2 - len(category))]
    slots = ", ".join(f"{value} AS {slot}" for value, slot in zip(values, SLOTS))
    return f"struct({index} AS distribution, {slots}, {weight} AS n)"


def _grid(index: int, d: Distribution) -> str:
    """SQL for the array of every (context..., category) cell, by its number."""
    size, values = d.contexts * len(d.domain), []
    step = size
    for domain in (*d.context_domains, d.domain):
        step //= len(domain)
        listed = ", ".join(f"'{v}'" for v in domain)
        values.append(f"array({listed})[CAST(i div {step} AS INT) % {len(domain)}]")
    return f"transform(sequence(0, {size - 1}), i -> {_cell(index, 0, values[:-1], values[-1:])})"


def count_cells(
    df: DataFrame, keys: Sequence[str], distributions: Sequence[Distribution], unseen: str = GRID
) -> DataFrame:
    """Count the cells of all distributions: keys, `distribution` (its index), slots, `n`.

    The first round of each sequence also emits what `unseen` names for smoothed
    distributions, so these are complete for every key without a join. The features must
    have been made for the same keys.
    """
    if len(distributions) == 1 and not distributions[0].smoothed:
        # The condition can then reach the scan, or at least stand before the counting.
        (d,) = distributions
        chosen = df.filter(d.included())
        return _count(chosen.select(*keys, F.expr(_cell(0, 1, d.context, d.category)).alias("cell")), keys)
    observed = ", ".join(
        f"CASE WHEN {d.included()} THEN {_cell(i, 1, d.context, d.category)} END"
        for i, d in enumerate(distributions)
    )
    cells = f"array({observed})"
    empty = [
        f"array({_cell(i, 0, [], [])})" if unseen == MARK else _grid(i, d)
        for i, d in enumerate(distributions)
        if d.smoothed and unseen != NOTHING
    ]
    if empty:
        first = follows(keys)
        if first not in df.columns:
            raise ValueError(f"smoothed distributions by {tuple(keys)} need features of these keys")
        grid = f"concat({', '.join(empty)})"
        cells = f"concat({cells}, CASE WHEN {first} THEN slice({grid}, 1, 0) ELSE {grid} END)"
    emitted = df.select(*keys, F.explode(F.expr(cells)).alias("cell"))
    return _count(emitted.filter("cell.distribution is not null"), keys)


def _count(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    flat = cells.select(*keys, "cell.*")
    return flat.groupBy(*keys, "distribution", *SLOTS).agg(F.sum("n").alias("n"))


def probabilities(
    cells: DataFrame,
    keys: Sequence[str],
    distributions: Sequence[Distribution],
    smoothing: str = REFERENCE,
) -> DataFrame:
    """Add `total` and `p` to counted cells.

    Smoothed distributions add one to each cell. With "laplace" the total grows by the
    number of categories, so a context sums to one. With "reference" that holds for
    observed cells only; a cell never observed keeps the bare grid's 1/categories.
    """
    if smoothing not in (REFERENCE, LAPLACE):
        raise ValueError(f"smoothing must be {REFERENCE!r} or {LAPLACE!r}, not {smoothing!r}")
    context = Window.partitionBy(*keys, "distribution", *SLOTS[:2])
    counted = cells.withColumn("total", F.sum("n").over(context))

    smoothed = {i: d for i, d in enumerate(distributions) if d.smoothed}
    if smoothed:
        is_smoothed = f"distribution IN ({', '.join(map(str, smoothed))})"
        sizes = " ".join(f"WHEN {i} THEN {len(d.domain)}" for i, d in smoothed.items())
        on_grid = " OR ".join(_on_grid(i, d) for i, d in smoothed.items())
        seen = "total" if smoothing == LAPLACE else "IF(n > 0, total, 0)"
        counted = counted.filter(f"NOT {is_smoothed} OR {on_grid}").withColumns(
            {
                "n": F.expr(f"IF({is_smoothed}, n + 1, n)"),
                "total": F.expr(f"IF({is_smoothed}, CASE distribution {sizes} END + {seen}, total)"),
            }
        )
    return counted.withColumn("p", F.expr("n / total"))


def observed_probabilities(
    cells: DataFrame,
    keys: Sequence[str],
    distributions: Sequence[Distribution],
    smoothing: str = REFERENCE,
) -> DataFrame:
    """Add `p` to the cells that were observed and `rest` to their context, without a grid.

    `rest` is the probability of each category that was never observed in this context, null where
    nothing is smoothed. A context never observed is not stated: all its categories are equally
    likely. The mark of a sequence stays, with the `rest` of such a context; its `p` is null, and so is
    that of observations outside the category set.
    """
    if smoothing not in (REFERENCE, LAPLACE):
        raise ValueError(f"smoothing must be {REFERENCE!r} or {LAPLACE!r}, not {smoothing!r}")
    context = Window.partitionBy(*keys, "distribution", *SLOTS[:2])
    counted = cells.withColumn("total", F.sum("n").over(context))
    smoothed = {i: d for i, d in enumerate(distributions) if d.smoothed}
    if not smoothed:
        return counted.withColumns({"p": F.expr("n / total"), "rest": F.lit(None).cast("double")})
    is_smoothed = f"distribution IN ({', '.join(map(str, smoothed))})"
    mark = "context_1 IS NULL AND context_2 IS NULL AND category_1 IS NULL"
    in_context = " OR ".join(_on_grid(i, d, category=False) for i, d in smoothed.items())
    on_grid = " OR ".join(_on_grid(i, d) for i, d in smoothed.items())
    sizes = f"CASE distribution {' '.join(f'WHEN {i} THEN {len(d.domain)}' for i, d in smoothed.items())} END"
    seen = f"IF({mark}, 0, total)"
    rest = f"1 / ({sizes} + {seen})" if smoothing == LAPLACE else f"1 / {sizes}"
    return counted.filter(f"NOT {is_smoothed} OR {in_context} OR {mark}").withColumns(
        {
            "p": F.expr(
                f"CASE WHEN NOT {is_smoothed} THEN n / total WHEN {on_grid} THEN (n + 1) / ({sizes} + total) END"
            ),
            "rest": F.expr(f"CASE WHEN {is_smoothed} THEN {rest} END"),
        }
    )


def in_domains(d: Distribution, category: bool = True) -> str:
    """SQL for a cell whose context, and category if asked for, lie in their domains."""
    slots = [*zip(SLOTS, d.context_domains), *[("category_1", d.domain)] * category]
    return " AND ".join(f"{slot} IN ({', '.join(map(repr, domain))})" for slot, domain in slots)


def _on_grid(index: int, d: Distribution, category: bool = True) -> str:
    return f"(distribution = {index} AND {in_domains(d, category)})"


def distribution(
    df: DataFrame,
    which: Distribution,
    keys: Sequence[str] = GAME_KEYS,
    smoothing: str = REFERENCE,
) -> DataFrame:
    """One distribution as a table: keys, context columns, category columns, n, total, p.

    `df` is the feature table; the bare rounds suffice where only the current move is used.
    """
    found = probabilities(count_cells(df, keys, [which]), keys, [which], smoothing)
    context = [F.col(s).alias(c) for s, c in zip(SLOTS[:2], which.context)]
    category = [F.col(s).alias(c) for s, c in zip(SLOTS[2:], which.category)]
    return found.select(*keys, *context, *category, "n", "total", "p")
