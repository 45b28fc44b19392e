"""Transforms that produce raw metrics from other systems' tables and pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.maps import explode_non_null, literal_map, pick
from tallyspark.functions.normalize import (
    is_topic_subject,
    normalize_metric_name,
    parse_instant,
    subject_topic,
)

SCHEMA_COUNT = "kafka.topic.schema.count"
PARTITION_COUNT = "kafka.topic.partition.count"

# The group field of a vendor page -> the tag that owns the metric.
GROUP_TAGS = {"metric.principal_id": "principal", "metric.topic": "topic"}


def add_tags(df: DataFrame, tags: Mapping[str, str]) -> DataFrame:
    """Constant tags on every row; they replace tags of the same name."""
    kept = F.map_filter(F.col("tags"), lambda k, _: ~k.isin(list(tags))) if tags else F.col("tags")
    return df.withColumn("tags", F.map_concat(kept, literal_map(tags)))


def select_series(
    raw: DataFrame, names: Sequence[str], tag_keys: Sequence[str], extra_tags: Mapping[str, str]
) -> DataFrame:
    """Keep the named metrics and tag keys, then add the global tags."""
    kept = raw.filter(F.col("name").isin(list(names))).withColumn(
        "tags", pick(F.col("tags"), [*tag_keys])
    )
    return add_tags(kept, extra_tags)


def _gauge(counts: DataFrame, name: str, at: Column, tags: Mapping[str, str]) -> DataFrame:
    rows = counts.select(
        at.alias("event_time"),
        at.alias("timestamp"),
        F.lit(name).alias("name"),
        F.create_map(F.lit("gauge"), F.col("n").cast("string")).alias("fields"),
        F.create_map(F.lit("topic"), F.col("topic")).alias("tags"),
    )
    return add_tags(rows, tags)


def schema_counts(subjects: DataFrame, at: Column, tags: Mapping[str, str] = {}) -> DataFrame:
    """Schemas per topic as a gauge; subjects that are no topic's key or value do not count."""
    counts = (
        subjects.select("subject", "version")
        .distinct()
        .filter(is_topic_subject(F.col("subject")))
        .groupBy(subject_topic(F.col("subject")).alias("topic"))
        .agg(F.count("*").alias("n"))
    )
    return _gauge(counts, SCHEMA_COUNT, at, tags)


def partition_counts(partitions: DataFrame, at: Column, tags: Mapping[str, str] = {}) -> DataFrame:
    counts = partitions.groupBy("topic").agg(F.count("*").alias("n"))
    return _gauge(counts, PARTITION_COUNT, at, tags)


def flatten_pages(pages: DataFrame) -> DataFrame:
    """Vendor pages (body JSON text, metric_name, group_by, cluster_id) to raw metrics.

    Pages of one query are rows like any other; an absent or empty page adds nothing, and a
    query grouped by another field is skipped.
    """
    known = pages.filter(F.col("group_by").isin(list(GROUP_TAGS)))
    points = F.from_json("body", "data ARRAY<MAP<STRING, STRING>>")["data"]
    owner_tag = literal_map(GROUP_TAGS)[F.col("group_by")]
    rows = explode_non_null(known, points, "_p", ["metric_name", "group_by", "cluster_id"]).select(
        parse_instant(F.col("_p")["timestamp"]).alias("timestamp"),
        normalize_metric_name(F.col("metric_name")).alias("name"),
        F.create_map(F.lit("value"), F.col("_p")["value"]).alias("fields"),
        F.create_map(
            F.lit("cluster_id"), F.col("cluster_id"), owner_tag, F.col("_p")[F.col("group_by")]
        ).alias("tags"),
    )
    return rows.select(F.col("timestamp").alias("event_time"), *rows.columns)


def metric_key(name: Column, tags: Column) -> Column:
    """Record key ``name:topic`` or ``name:principal``; null when there is neither."""
    return F.concat_ws(":", name, F.coalesce(tags["topic"], tags["principal"]))


def metric_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("name").agg(F.count("*").alias("sent"))


def usage_by_cluster_principal(raw: DataFrame, value: Column) -> DataFrame:
    """Produced and fetched bytes per (cluster, principal)."""
    tags, name = F.col("tags"), F.col("name")
    made = (name == "confluent_kafka_server_request_bytes") & (tags["type"] == "Produce")
    got = (name == "confluent_kafka_server_response_bytes") & (tags["type"] == "Fetch")
    return (
        raw.filter(made | got)
        .groupBy(tags["kafka_id"].alias("kafka_id"), tags["principal_id"].alias("principal_id"))
        .agg(
            F.sum(F.when(made, value)).alias("produced_bytes"),
            F.sum(F.when(got, value)).alias("fetched_bytes"),
        )
    )


def usage_by_cluster_topic(raw: DataFrame, value: Column) -> DataFrame:
    """Least and most retained bytes and the consumer groups per (cluster, topic)."""
    tags, name = F.col("tags"), F.col("name")
    kept = name == "confluent_kafka_server_retained_bytes"
    lag = name == "confluent_kafka_server_consumer_lag_offsets"
    return (
        raw.filter(kept | lag)
        .groupBy(tags["kafka_id"].alias("kafka_id"), tags["topic"].alias("topic"))
        .agg(
            F.min(F.when(kept, value)).alias("retained_bytes_min"),
            F.max(F.when(kept, value)).alias("retained_bytes_max"),
            F.array_join(
                F.array_sort(F.collect_set(F.when(lag, tags["consumer_group_id"]))), ","
            ).alias("consumergroups"),
        )
    )
