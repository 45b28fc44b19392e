"""Column functions that turn a raw record into (entity, metric, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.maps import compute_once

# Field names that carry the value, in order of preference.
VALUE_FIELDS = ("gauge", "counter")
TOPIC_TAG = "topic"


def metric_value(fields: Column) -> Column:
    """gauge, else counter, else the alphabetically first field, else 0.0; bad numbers are 0.0."""
    picked = F.try_element_at(fields, F.array_min(F.map_keys(fields)))
    for key in reversed(VALUE_FIELDS):
        picked = F.when(F.map_contains_key(fields, key), fields[key]).otherwise(picked)
    return F.coalesce(picked.try_cast("double"), F.lit(0.0))


def entity_type(tags: Column, principal_tags: Sequence[str] = ("principal_id",)) -> Column:
    kind = F.when(F.map_contains_key(tags, TOPIC_TAG), "TOPIC")
    for tag in principal_tags:
        kind = kind.when(F.map_contains_key(tags, tag), "PRINCIPAL")
    return kind.otherwise("UNKNOWN")


def entity_name(tags: Column, principal_tags: Sequence[str] = ("principal_id",)) -> Column:
    name = F.when(F.map_contains_key(tags, TOPIC_TAG), tags[TOPIC_TAG])
    for tag in principal_tags:
        name = name.when(F.map_contains_key(tags, tag), tags[tag])
    return name.otherwise("")


def normalize(raw: DataFrame, principal_tags: Sequence[str] = ("principal_id",)) -> DataFrame:
    """Raw records to metric rows. Tags do not survive aggregation, so they end here."""
    tags = F.col("tags")
    computed = compute_once(
        raw,
        {
            "entity_type": entity_type(tags, principal_tags),
            "name": entity_name(tags, principal_tags),
            "initial_metric_name": F.col("name"),
            "value": metric_value(F.col("fields")),
        },
        ["event_time", "timestamp"],
    )
    return drop_invalid(computed)


def drop_invalid(metrics: DataFrame) -> DataFrame:
    return metrics.filter(
        F.col("entity_type").isNotNull()
        & F.col("name").isNotNull()
        & F.col("initial_metric_name").isNotNull()
    )


def normalize_metric_name(name: Column) -> Column:
    """Dots and slashes to underscores, then every ``io_`` removed."""
    return F.replace(F.regexp_replace(name, "[./]", "_"), F.lit("io_"), F.lit(""))


def has_one_owner_tag(tags: Column, principal_tag: str = "principal") -> Column:
    return F.map_contains_key(tags, TOPIC_TAG) != F.map_contains_key(tags, principal_tag)


def validate_metric_tags(df: DataFrame, principal_tag: str = "principal"):
    """(accepted, rejected): a metric belongs to exactly one of topic and principal."""
    ok = F.coalesce(has_one_owner_tag(F.col("tags"), principal_tag), F.lit(False))
    return df.filter(ok), df.filter(~ok)


def is_topic_subject(subject: Column) -> Column:
    return subject.endswith("-key") | subject.endswith("-value")


def subject_topic(subject: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(subject, "-value$", ""), "-key$", "")


def parse_instant(text: Column) -> Column:
    """ISO-8601 text in UTC (``...Z``) or with an offset (``+01:00``) to an instant; else null."""
    iso = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2})$")
    return F.when(iso, F.try_to_timestamp(text))


def epoch_to_instant(number: Column, unit: str) -> Column:
    """Epoch text or number in ``seconds`` (fraction allowed) or ``millis`` to an instant."""
    scale = {"seconds": 1_000_000, "millis": 1_000}[unit]
    micros = (number.try_cast("decimal(38,6)") * F.lit(scale)).try_cast("bigint")
    return F.timestamp_micros(micros)


def epoch_millis(instant: Column) -> Column:
    return F.unix_millis(instant)


def last_full_hour(now: Column):
    """[start, end) of the last complete hour before ``now``."""
    end = F.date_trunc("hour", now)
    return end - F.expr("INTERVAL 1 HOUR"), end


def price_per_gb(metric_name: Column, cost_factor: Column) -> Column:
    """Price of one GiB for byte metrics, five decimals, halves upward; null for others."""
    scaled = cost_factor * F.lit(1024.0 * 1024.0 * 1024.0 * 100000.0)
    return F.when(metric_name.endswith("bytes"), F.floor(scaled + 0.5) / F.lit(100000.0))
