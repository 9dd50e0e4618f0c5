"""Transforms that need no state work on streams as they are: each looks at one row at a time, or joins a static frame.

Verbs that look at whole frames (sort, aggregate, deduce, diff, profiles, encodings that first collect categories) are
refused here rather than given new meanings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.errors import LoomError
from loomframe.operators import columns
from loomframe.operators.aggregate import need_unique
from loomframe.operators.columns import quoted

STATELESS = {"calc": columns.calc, "filter": columns.filter_rows, "round": columns.round_columns, "split": columns.split, "extract": columns.extract, "harmonize": columns.harmonize, "bin": columns.bin_column, "datetime": columns.to_datetime}


def apply(stream: DataFrame, verb: str, *args, **kwargs) -> DataFrame:
    if verb not in STATELESS:
        raise LoomError(f"'{verb}' needs whole frames", f"On streams there are: {', '.join([*STATELESS, 'enrich'])}")
    if verb == "extract" and not (kwargs.get("parts") or kwargs.get("pattern") or len(args) > 1):
        raise LoomError("extract on a stream needs its parts named", "It can't look at values first")
    return STATELESS[verb](stream, *args, **kwargs)


def enrich(stream: DataFrame, reference: DataFrame, bring: list[str], against: str | list[str]) -> DataFrame:
    """Stream-static left join against a reference with unique keys."""
    keys = [against] if isinstance(against, str) else list(against)
    need_unique(reference, keys, "reference", "Aggregate it first")
    return stream.join(reference.select(*map(quoted, keys), *map(F.col, bring)), keys, "left")
