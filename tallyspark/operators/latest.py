"""Changelog to current rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_by_key(
    changelog: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    tombstone: Column | None = None,
) -> DataFrame:
    """The newest row per key; keys whose newest row is a tombstone are gone.

    An aggregate rather than a ranking window: each task first keeps one row per key,
    so a key that holds a large part of the changelog does not land in one task whole. All
    columns of ``changelog`` travel, those of ``order`` once if they are not read afterwards:
    callers leave out what they do not need.
    """
    rest = [c for c in changelog.columns if c not in keys and c not in order]
    newest = changelog.groupBy(*keys).agg(
        F.max_by(F.struct(F.lit(0).alias("_"), *rest), F.struct(*order)).alias("_newest"),
        F.max(F.struct(*order)).alias("_order"),
    )
    at = [F.col("_order")[c].alias(c) for c in order if c not in keys]
    current = newest.select(*keys, *[F.col("_newest")[c].alias(c) for c in rest], *at).select(*changelog.columns)
    return current if tombstone is None else current.filter(~tombstone)
