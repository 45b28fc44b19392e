"""Live gauges: the current value of every series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.config import MeteringConfig
from tallyspark.functions.maps import canonical_json, explode_non_null, json_to_map, put
from tallyspark.session import written


def gauge_samples(facts: DataFrame, prefix: str = "", *kept: str) -> DataFrame:
    """(name, tags, value, event_time): tags are the context plus entity type = entity name,
    which wins over a context entry of the same key."""
    kind = F.lower("entity_type")
    return facts.select(
        F.concat(F.lit(prefix), "initial_metric_name").alias("name"),
        put(F.col("context"), kind, F.col("name")).alias("tags"),
        "value",
        F.col("start_time").alias("event_time"),
        *kept,
    )


def gauge_snapshot(samples: DataFrame) -> DataFrame:
    """Last value by event time per series. All series of one name carry the same tag keys,
    missing ones as empty text.

    The last values are written, a row per series: they are used twice, and the samples are
    then scanned once.
    """
    keyed = samples.withColumn("tags_json", canonical_json(F.col("tags")))
    last = written(_last_value(keyed), "gauges")
    return padded(last, last)


def padded(series: DataFrame, every: DataFrame) -> DataFrame:
    """``series`` (name, tags_json, value, last_seen) with the tag keys that any series of ``every`` of
    that name has; of series that thereby become equal the newest stays."""
    key_sets = every.select(
        "name", F.array_sort(F.map_keys(json_to_map(F.col("tags_json")))).alias("_k")
    ).distinct()
    keys = (
        explode_non_null(key_sets, F.col("_k"), "_k", ["name"])
        .groupBy(F.col("name").alias("_name"))
        .agg(F.array_sort(F.collect_set("_k")).alias("_keys"))
    )
    tags = json_to_map(F.col("tags_json"))
    wide = (
        series.withColumn("_tags", tags)
        .join(keys, F.col("name") == F.col("_name"))
        .withColumn(
            "tags_json",
            F.to_json(
                F.map_from_arrays(
                    "_keys",
                    F.transform("_keys", lambda k: F.coalesce(F.col("_tags")[k], F.lit(""))),
                )
            ),
        )
    )
    # padding can make two series equal: an explicit empty tag and a missing one
    merged = wide.groupBy("name", "tags_json").agg(
        F.max_by("value", F.struct("last_seen", "value")).alias("value"), F.max("last_seen").alias("last_seen")
    )
    return merged.withColumn("tags", json_to_map(F.col("tags_json")))


def _last_value(samples: DataFrame) -> DataFrame:
    return samples.groupBy("name", "tags_json").agg(
        F.max_by("value", F.struct("event_time", "value")).alias("value"), F.max("event_time").alias("last_seen")
    )


def active_gauges(snapshot: DataFrame, config: MeteringConfig) -> DataFrame:
    """Without the series whose last update is older than a window and half a minute, seen
    from the newest event time."""
    now = snapshot.agg(F.max("last_seen")).scalar()
    timeout = F.expr(f"INTERVAL {int(config.gauge_timeout.total_seconds())} SECONDS")
    return snapshot.filter(F.col("last_seen") + timeout >= now)
