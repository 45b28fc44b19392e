"""History over a time range: raw, per entity, per context value and bucket."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.buckets import bucket_seconds, bucket_start, range_or_default
from tallyspark.session import written
from tallyspark.sources.facts import contained

UNKNOWN_LABEL = "unknown"


def history(
    facts: DataFrame,
    start: datetime | None = None,
    end: datetime | None = None,
    metrics: Iterable[str] = (),
) -> DataFrame:
    """Facts inside the range (default: last 30 days); no metrics named means all."""
    start, end = range_or_default(start, end)
    rows = facts.filter(contained(start, end))
    wanted = sorted(set(metrics))
    return rows.filter(F.col("initial_metric_name").isin(wanted)) if wanted else rows


def history_series(
    facts: DataFrame,
    start: datetime | None = None,
    end: datetime | None = None,
    metrics: Iterable[str] = (),
    max_points: int = 100_000,
) -> DataFrame:
    """Per entity name two parallel arrays, times and values, in time order.

    A chart shape. One row cannot hold any number of points, so a longer series continues
    in further rows, numbered by ``chunk``; its points stay in order.
    """
    points = history(facts, start, end, metrics).select("name", "start_time", "value", "row_id")
    numbered = numbered_in_order(points, ["name"], ["start_time", "value", "row_id"])
    chunk = F.floor(F.col("number") / max_points).alias("chunk")
    pairs = F.array_sort(F.collect_list(F.struct("start_time", "value")))
    return (
        numbered.groupBy("name", chunk)
        .agg(pairs.alias("_p"))
        .select("name", "chunk", F.col("_p.start_time").alias("times"), F.col("_p.value").alias("values"))
    )


def numbered_in_order(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows with ``number``, their place from 0 within a key in the given order.

    A key of any size is spread: the rows are sorted over range partitions and written once with
    their place there, and what a key has in earlier partitions is added. Only counts per key and
    partition meet in a window. Rows that are equal in keys and order lie in one partition, so the
    order should end in something that tells rows apart.
    """
    by = [*keys, *order]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    places = written(ordered.withColumns({"_part": F.spark_partition_id(), "_place": place}), "places")
    parts = places.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_part").alias("_of"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_offset"))
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    joined = places.join(offsets, functools.reduce(Column.__and__, same, F.col("_part") == F.col("_of")))
    return joined.select(*rows.columns, (F.col("_place") + F.col("_offset")).alias("number"))


def context_label(key: str, missing: str = UNKNOWN_LABEL) -> Column:
    return F.coalesce(F.col("context")[key], F.lit(missing))


def history_grouped(
    facts: DataFrame,
    start: datetime | None,
    end: datetime | None,
    metrics: Iterable[str],
    key: str,
    width_hours: int | None = None,
    more_keys: Iterable[str] = (),
) -> DataFrame:
    """sum(value) per context value and time bucket; buckets are counted from ``start``."""
    start, end = range_or_default(start, end)
    width = bucket_seconds(start, end, width_hours)
    return (
        history(facts, start, end, metrics)
        .groupBy(
            context_label(key).alias("name"),
            *[context_label(k).alias(k) for k in more_keys],
            bucket_start(F.col("start_time"), start, width).alias("time"),
        )
        .agg(F.sum("value").alias("value"))
    )


def history_single_bucket(facts, start, end, metrics, key: str) -> DataFrame:
    """One bucket for the whole range (its whole hours)."""
    start, end = range_or_default(start, end)
    hours = int((end - start).total_seconds() // 3600)
    return history_grouped(facts, start, end, metrics, key, hours)


def metric_totals(
    facts: DataFrame,
    start: datetime | None = None,
    end: datetime | None = None,
    metrics: Iterable[str] = (),
) -> DataFrame:
    return (
        history(facts, start, end, metrics)
        .groupBy("initial_metric_name")
        .agg(F.sum("value").alias("total"))
    )
