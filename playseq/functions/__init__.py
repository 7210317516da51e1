from playseq.functions.expressions import (
    cyclic_transition,
    entropy_term,
    is_move,
    label_of,
    ordinal_of,
    payoff_of_choice,
)

__all__ = [
    "cyclic_transition",
    "entropy_term",
    "is_move",
    "label_of",
    "ordinal_of",
    "payoff_of_choice",
]
