"""Share of a group total without pulling a whole group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_group_total(
    grouped: DataFrame, keys: Sequence[str], value: str, total: str = "group_total"
) -> DataFrame:
    """Add sum(value) per ``keys``.

    An aggregate joined back, not a window: a window would gather every row of a group
    (one metric may hold most rows) in a single task. The totals are a few rows, which the
    adaptive planner turns into a broadcast once it has seen their size.
    """
    totals = grouped.groupBy(*keys).agg(F.sum(value).alias(total))
    renamed = totals.select(*[F.col(k).alias(f"_t_{k}") for k in keys], total)
    cond = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_t_{k}"))
        cond = same if cond is None else cond & same
    return grouped.join(renamed, cond, "left").drop(*[f"_t_{k}" for k in keys])
