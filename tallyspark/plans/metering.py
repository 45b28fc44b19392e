"""The metering run: raw records to labelled, split, windowed and priced facts."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.config import MeteringConfig, duration_seconds
from tallyspark.functions.buckets import as_utc, instant, micros
from tallyspark.functions.normalize import normalize
from tallyspark.operators.labels import (
    CompiledRules,
    compile_rules,
    context_segments,
    enrich,
    label,
    validity_slot,
)
from tallyspark.operators.pricing import price
from tallyspark.operators.split import split_among_principals
from tallyspark.operators.windows import as_windows, pre_aggregate, window_aggregate
from tallyspark.session import cut_lineage
from tallyspark.sources.facts import to_facts


def windowed_usage(
    raw: DataFrame,
    rules: DataFrame | CompiledRules,
    config: MeteringConfig,
    materialize: bool = False,
) -> DataFrame:
    """Windowed rows with context, before pricing.

    Samples shrink to one row per entity, metric, window and validity slot first; sum and
    maximum allow that, and a split divides by a constant, so the later steps give the same
    result on the shrunken rows. ``materialize`` writes the shrunken rows to the checkpoint
    folder, for raw sources that are too dear to scan twice.
    """
    compiled = rules if isinstance(rules, CompiledRules) else compile_rules(rules)
    metrics = normalize(raw, config.principal_tags)
    small = pre_aggregate(metrics, config, validity_slot(F.col("timestamp"), compiled))
    if materialize:
        metrics = small = cut_lineage(small)
    if compiled.inline is not None:
        labelled = split_among_principals(label(small, compiled), config, compiled)
    else:
        segments = context_segments(metrics, compiled)
        labelled = split_among_principals(
            enrich(small, segments, types=compiled.types, many=compiled.boundaries is None), config, compiled, topic_segments=segments
        )
    if not config.split_keys and compiled.always_valid:
        return as_windows(labelled, config)  # one label per entity: nothing left to merge
    return window_aggregate(labelled, config)


def usage_facts(
    raw: DataFrame,
    rules: DataFrame | CompiledRules,
    prices: DataFrame,
    config: MeteringConfig,
    materialize: bool = False,
) -> DataFrame:
    return to_facts(price(windowed_usage(raw, rules, config, materialize), prices))


def window_floor(moment: datetime, config: MeteringConfig) -> datetime:
    size = duration_seconds(config.window) * 1_000_000
    return as_utc(moment) - timedelta(microseconds=micros(moment) % size)


def reprocess(
    raw: DataFrame,
    rules: DataFrame | CompiledRules,
    prices: DataFrame,
    config: MeteringConfig,
    start_time: datetime | None = None,
    materialize: bool = False,
) -> DataFrame:
    """Facts anew from ``start_time`` (null: from the beginning), ready for an upsert.

    The start moves back to its window boundary: a window is recomputed whole or not at all.
    """
    if start_time is not None:
        raw = raw.filter(F.col("event_time") >= instant(window_floor(start_time, config)))
    return usage_facts(raw, rules, prices, config, materialize)


def unclassified_entities(facts: DataFrame) -> DataFrame:
    """Entities seen in the data that no rule gave a context to in any of their windows."""
    seen = facts.groupBy("entity_type", "name").agg(
        F.bool_or(F.size("context") > 0).alias("_labelled"), F.count("*").alias("windows")
    )
    return seen.filter(~F.col("_labelled")).drop("_labelled")
