"""Where new columns stand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.errors import LoomError, need_columns


def place(df: DataFrame, new: list[str], position: str | int | None) -> DataFrame:
    """df with the columns `new` moved: 'start', 'end', 'after:<column>', 'before:<column>' or an index among the other
    columns (a negative one counts from the end)."""
    if position is None:
        return df
    rest = [c for c in df.columns if c not in new]
    if position == "start":
        at = 0
    elif position == "end":
        at = len(rest)
    elif isinstance(position, bool) or not isinstance(position, (str, int)):
        raise LoomError(f"'{position}' is no position")
    elif isinstance(position, int):
        at = position + len(df.columns) if position < 0 else position
        if not 0 <= at < len(df.columns):
            raise LoomError(f"position {position} is out of range", f"There are {len(df.columns)} columns")
        at = min(at, len(rest))
    else:
        side, _, column = position.partition(":")
        if side not in ("after", "before"):
            raise LoomError(f"'{position}' is no position", "There are: start, end, after:<column>, before:<column>, a number")
        need_columns(rest, [column])
        at = rest.index(column) + (side == "after")
    return df.select(*[F.col(f"`{c}`") for c in [*rest[:at], *[c for c in df.columns if c in new], *rest[at:]]])
