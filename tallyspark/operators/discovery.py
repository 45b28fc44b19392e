"""What is there: metrics, context keys and their values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.config import MeteringConfig
from tallyspark.functions.maps import explode_non_null, json_to_map, pick


def metric_names(facts: DataFrame, config: MeteringConfig) -> DataFrame:
    metric = F.col("metric_name")
    kind = F.when(metric.isin(config.max_metrics), "MAX").otherwise("SUM")
    return (
        facts.groupBy(F.col("initial_metric_name").alias("metric_name"))
        .agg(F.max("end_time").alias("last_seen"))
        .withColumn("aggregation_type", kind)
    )


def raw_metric_names(raw: DataFrame, config: MeteringConfig) -> DataFrame:
    metric = F.col("metric_name")
    kind = F.when(metric.isin(config.max_metrics), "MAX").otherwise("SUM")
    return (
        raw.groupBy(F.col("name").alias("metric_name"))
        .agg(F.max("timestamp").alias("last_seen"))
        .withColumn("aggregation_type", kind)
        .orderBy("metric_name")
    )


def distinct_metrics(facts: DataFrame) -> DataFrame:
    return facts.select("initial_metric_name").distinct()


def map_keys_of(df: DataFrame, m: Column, alias: str) -> DataFrame:
    # one key set per distinct combination first, so the explode sees few rows
    sets = df.select(F.array_sort(F.map_keys(m)).alias("_keys")).distinct()
    return explode_non_null(sets, F.col("_keys"), alias).distinct()


def context_keys(facts: DataFrame) -> DataFrame:
    return map_keys_of(facts, F.col("context"), "context_key").orderBy("context_key")


def context_values(facts: DataFrame, key: str) -> DataFrame:
    value = F.col("context")[key]
    return facts.filter(value.isNotNull()).select(value.alias("context_value")).distinct()


def _tags(df: DataFrame) -> Column:
    tags = F.col("tags")
    return json_to_map(tags) if dict(df.dtypes)["tags"] == "string" else tags


def tag_keys(df: DataFrame) -> DataFrame:
    return map_keys_of(df, _tags(df), "tag_key").orderBy("tag_key")


def tag_values(df: DataFrame, key: str) -> DataFrame:
    value = _tags(df)[key]
    return df.filter(value.isNotNull()).select(value.alias("tag_value")).distinct()


def pick_context(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumn("context", pick(F.col("context"), keys))
