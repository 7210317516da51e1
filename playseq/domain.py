"""Schema, category domains, payoff table and labels shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

ROUNDS = T.StructType(
    [
        T.StructField("game_id", T.StringType()),
        T.StructField("player_id", T.StringType()),
        T.StructField("round_index", T.IntegerType()),
        T.StructField("player_move", T.StringType()),
        T.StructField("player_outcome", T.StringType()),
    ]
)

# What identifies one sequence of moves: a player within a game, or a player over all games.
GAME_KEYS = ("game_id", "player_id")
PLAYER_KEYS = ("player_id",)

# Category domains in their natural order, the marker for "no move
# made", the payoff of each choice (row) against each opponent choice (column),
# and the length of a complete game.
MOVES = ("rock", "paper", "scissors")
TRANSITIONS = ("+", "-", "0")
OUTCOMES = ("win", "loss", "tie")
NO_MOVE = "none"
PAYOFF = (
    (0.0, -1.0, 1.0),
    (1.0, 0.0, -1.0),
    (-1.0, 1.0, 0.0),
)
STEPS = (1, -1, 0)
GAME_ROUNDS = 300
MIN_ROUNDS = 300

Payoff = tuple[tuple[float, ...], ...]


@dataclass(frozen=True)
class Game:
    """The category sets and payoffs of a game of any number of choices.

    `transitions[i]` names a step of `steps[i]` places around `cycle`, by default the choices in their
    order. A step without a name is null: a category of its own, which no choice pays off against. A
    payoff has a row for each choice and a column for each of the opponent's; that of transitions has a
    row and a column for each transition and is by default the same table. The first outcome is a win,
    the second a loss, the third a tie.
    """

    choices: tuple[str, ...]
    payoff: Payoff
    cycle: tuple[str, ...] = ()
    transitions: tuple[str, ...] = TRANSITIONS
    steps: tuple[int, ...] = STEPS
    transition_payoff: Payoff = ()
    outcomes: tuple[str, str, str] = OUTCOMES

    def __post_init__(self) -> None:
        object.__setattr__(self, "cycle", self.cycle or self.choices)
        object.__setattr__(self, "transition_payoff", self.transition_payoff or self.payoff)
        k, t = len(self.choices), len(self.transitions)
        if min(k, t) < 2:
            raise ValueError("a game has at least two choices and two transitions")
        for name, values in (("choices", self.choices), ("cycle", self.cycle), ("transitions", self.transitions),
                             ("outcomes", self.outcomes), ("steps", [s % len(self.cycle) for s in self.steps])):
            if len(set(values)) < len(values):
                raise ValueError(f"{name} repeat a value: {values}")
        if NO_MOVE in self.choices or not set(self.cycle) <= set(self.choices):
            raise ValueError(f"the cycle must go through choices, and {NO_MOVE!r} is none")
        if len(self.steps) != t:
            raise ValueError("each transition names one step")
        for size, table in ((k, self.payoff), (t, self.transition_payoff)):
            if len(table) != size or any(len(row) != size for row in table):
                raise ValueError(f"a payoff of {size} categories must have {size} rows and columns")

    def values_of(self, column: str) -> tuple[str, ...]:
        """The category set of a feature column."""
        if "transition" in column:
            return self.transitions
        return self.outcomes if column.endswith("outcome") else self.choices


RPS = Game(MOVES, PAYOFF)

# Figure labels in display order.
LABELS = (
    "Choice base rate (R/P/S)",
    "Transition base rate (+/−/0)",
    "Opponent transition base rate (+/−/0)",
    "Choice given player's prior choice",
    "Choice given opponent's prior choice",
    "Transition given prior outcome (W/L/T)",
    "Choice given player's prior two choices",
    "Transition given prior transition & prior outcome",
)

# The dependency each label describes, in the same order.
LABELLED_DEPENDENCIES = (
    "move",
    "transition",
    "cournot_transition",
    "prev_move",
    "opponent_prev_move",
    "outcome_transition",
    "prev_2move",
    "prev_transition_prev_outcome",
)
