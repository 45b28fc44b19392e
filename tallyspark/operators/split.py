"""Splitting a topic metric among the principals its context lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.config import MeteringConfig, MissingKey
from tallyspark.functions.maps import explode_non_null, literal_map, put
from tallyspark.operators.labels import CompiledRules, label


def list_members(text: Column) -> Column:
    """Members of a comma list: trailing empty ones do not count, an empty text is one
    empty member, a text of commas only has none. Nothing is trimmed."""
    members = F.split(F.regexp_replace(text, ",+$", ""), ",")
    return F.when(text.rlike("^,+$"), F.array().cast("array<string>")).otherwise(members)


def split_member_names(labelled: DataFrame, config: MeteringConfig) -> DataFrame:
    """Every principal a split could produce, from labelled topics (rows or label segments)."""
    keys = sorted(set(config.split_keys.values()))
    lists = F.array_compact(F.array(*[list_members(F.col("context")[k]) for k in keys]))
    topics = labelled.filter(F.col("entity_type") == "TOPIC")
    members = explode_non_null(topics, F.flatten(lists), "name")
    fallback = labelled.sparkSession.range(1).select(F.lit(config.fallback_principal).alias("name"))
    return members.union(fallback).distinct().select(F.lit("PRINCIPAL").alias("entity_type"), "name")


def split_among_principals(
    metrics: DataFrame,
    config: MeteringConfig,
    compiled: CompiledRules,
    at: str = "timestamp",
    topic_segments: DataFrame | None = None,
) -> DataFrame:
    """One row per member with an equal share of value (and cost, when there is one).

    A produced row belongs to the member and carries the member's own context plus ``topic``.
    ``topic_segments``, the labels of the topics, spare a second pass over ``metrics`` to
    find the members when the rules are too many to be inlined.
    """
    if not config.split_keys:
        return metrics
    metric, context = F.col("initial_metric_name"), F.col("context")
    split_key = literal_map(config.split_keys)[metric]
    policies = {m: config.policy_of(m).value for m in config.split_keys}
    policy = literal_map(policies)[metric]

    nobody = F.array().cast("array<string>")
    untouched = F.array(F.lit(None).cast("string"))
    missing = (
        F.when(policy == MissingKey.PASS_THROUGH.value, untouched)
        .when(policy == MissingKey.DROP.value, nobody)
        .otherwise(F.array(F.lit(config.fallback_principal)))
    )
    listed = context[split_key]
    members = (
        F.when((F.col("entity_type") != "TOPIC") | split_key.isNull(), untouched)
        .when(listed.isNull(), missing)
        .otherwise(list_members(listed))
    )

    # The outer form keeps the optimizer from deriving a "has members" filter, which it would
    # push, with all of the labelling in it, down to the scan. A row without members shows as
    # a null struct and goes here.
    exploded = (
        metrics.withColumn("_members", members)
        .withColumn("_n", F.size("_members"))
        .withColumn(
            "_m", F.explode_outer(F.transform("_members", lambda m: F.struct(m.alias("name"))))
        )
        .filter(F.col("_m").isNotNull())
        .withColumn("_member", F.col("_m")["name"])
    )
    is_share = F.col("_member").isNotNull()
    shares = exploded.withColumns(
        {
            "_topic": F.when(is_share, F.col("name")),
            "_old_context": F.col("context"),
            "entity_type": F.when(is_share, "PRINCIPAL").otherwise(F.col("entity_type")),
            "name": F.coalesce("_member", "name"),
            **{
                c: F.when(is_share, F.col(c) / F.col("_n")).otherwise(F.col(c))
                for c in ("value", "cost")
                if c in metrics.columns
            },
        }
    )
    names = None
    if compiled.inline is None:
        names = split_member_names(metrics if topic_segments is None else topic_segments, config)
    labelled = label(shares, compiled, at, names)
    return labelled.withColumn(
        "context",
        F.when(is_share, put(F.col("context"), "topic", F.col("_topic"))).otherwise(
            F.col("_old_context")
        ),
    ).drop("_members", "_n", "_m", "_member", "_topic", "_old_context")
