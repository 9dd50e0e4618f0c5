"""One family of errors: what is wrong, and what may help."""

from __future__ import annotations


class LoomError(ValueError):
    def __init__(self, message: str, hint: str = ""):
        super().__init__(f"{message}. {hint}" if hint else message)
        self.message, self.hint = message, hint


class FormulaError(LoomError):
    """A formula that can't be read; position is the offset of the offending character."""

    def __init__(self, message: str, position: int = 0, hint: str = ""):
        super().__init__(f"{message} at position {position}", hint)
        self.position = position


class CardinalityError(LoomError):
    """Keys that repeat where they must not."""


def edits(a: str, b: str) -> int:
    """Levenshtein distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def need_columns(have: list[str], wanted: list[str], what: str = "column") -> None:
    """Raise for the first wanted column that isn't there, with names at most two edits away."""
    for c in wanted:
        if c not in have:
            near = [h for h in have if edits(h.lower(), c.lower()) <= 2]
            raise LoomError(f"{what} '{c}' not found", f"Did you mean {', '.join(near)}?" if near else f"There are: {', '.join(have)}")
