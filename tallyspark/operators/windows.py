"""Tumbling-window reduction by sum or maximum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.config import MeteringConfig, duration_seconds
from tallyspark.functions.maps import canonical_json, json_to_map


def reduced_value(config: MeteringConfig, metric: Column, value: Column) -> Column:
    """Sum, or maximum for the configured metrics. Both parts combine on the map side."""
    total = F.sum(value)
    if not config.max_metrics:
        return total
    return F.when(metric.isin(config.max_metrics), F.max(value)).otherwise(total)


def pre_aggregate(
    metrics: DataFrame,
    config: MeteringConfig,
    slot: Column,
) -> DataFrame:
    """Rows of one entity, metric, window and validity slot become one row.

    Runs before labelling, so that what is shuffled and joined grows with entities and
    windows and not with samples, and an entity that holds a third of all samples arrives
    as a few rows per task.
    """
    return metrics.groupBy(
        F.window("event_time", config.window).start.alias("event_time"),
        slot.alias("timestamp"),
        "entity_type",
        "name",
        "initial_metric_name",
    ).agg(reduced_value(config, F.col("initial_metric_name"), F.col("value")).alias("value"))


def window_groups(metrics: DataFrame, config: MeteringConfig):
    """The grouping shared by batch and stream: window, entity, metric and canonical context."""
    return metrics.groupBy(
        F.window("event_time", config.window).alias("window"),
        "entity_type",
        "name",
        "initial_metric_name",
        "context_json",
    ).agg(reduced_value(config, F.col("initial_metric_name"), F.col("value")).alias("value"))


def window_columns(windowed: DataFrame) -> DataFrame:
    return windowed.select(
        F.col("window.start").alias("start_time"),
        F.col("window.end").alias("end_time"),
        "entity_type",
        "name",
        "initial_metric_name",
        "value",
        F.lit("{}").alias("tags"),
        json_to_map(F.col("context_json")).alias("context"),
        "context_json",
    )


def as_windows(labelled: DataFrame, config: MeteringConfig) -> DataFrame:
    """Pre-aggregated rows with one label per entity are windows already."""
    size = F.expr(f"INTERVAL {duration_seconds(config.window)} SECONDS")
    return labelled.select(
        F.col("event_time").alias("start_time"),
        (F.col("event_time") + size).alias("end_time"),
        "entity_type",
        "name",
        "initial_metric_name",
        "value",
        F.lit("{}").alias("tags"),
        "context",
        canonical_json(F.col("context")).alias("context_json"),
    )


def window_aggregate(metrics: DataFrame, config: MeteringConfig) -> DataFrame:
    """Windowed rows per (entity, metric, context), aligned to the epoch."""
    keyed = metrics.withColumn("context_json", canonical_json(F.col("context"))).drop("context")
    return window_columns(window_groups(keyed, config))


def series_max(df: DataFrame, period: str) -> DataFrame:
    """Largest sample of a gauge per series (name and all tags) and period."""
    return _per_series(df, period).agg(F.max("value").alias("value"))


def series_diff(df: DataFrame, window: str) -> DataFrame:
    """Last minus first sample of a counter per series and sixth of the window."""
    period = f"{max(1, duration_seconds(window) // 6)} seconds"
    at = F.struct("event_time", "value")  # of samples at one instant the larger is the later
    diff = F.max_by("value", at) - F.min_by("value", at)
    return _per_series(df, period).agg(diff.alias("value"))


def _per_series(df: DataFrame, period: str):
    keyed = df.withColumn("tags_json", canonical_json(F.col("tags")))
    return keyed.groupBy(
        F.window("event_time", period).start.alias("period_start"), "name", "tags_json"
    )


def rollup(facts: DataFrame, unit: str, config: MeteringConfig, keys: Sequence[str] = ()) -> DataFrame:
    """Facts per day, week or month; MAX metrics stay maxima."""
    metric = F.col("initial_metric_name")
    return facts.groupBy(
        F.date_trunc(unit, "start_time").alias("period_start"),
        "initial_metric_name",
        *[F.col("context")[k].alias(k) for k in keys],
    ).agg(
        reduced_value(config, metric, F.col("value")).alias("value"), F.sum("cost").alias("cost")
    )
