"""Settings of a metering run; checked when the object is built."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import timedelta
from enum import Enum

# Metric -> context key whose comma list a topic metric is split by.
DEFAULT_SPLIT_KEYS = {
    "kafka_server_brokertopicmetrics_bytesout_total": "readers",
    "kafka_server_brokertopicmetrics_bytesin_total": "writers",
    "kafka_log_log_size": "writers",
}

# Metrics reduced by something else than a sum.
DEFAULT_AGGREGATIONS = {"confluent_kafka_server_retained_bytes": "max"}


class AggregationType(str, Enum):
    SUM = "SUM"
    MAX = "MAX"


class MissingKey(str, Enum):
    """What to do with a topic metric whose context lacks the split key."""

    ASSIGN_TO_FALLBACK = "ASSIGN_TO_FALLBACK"
    PASS_THROUGH = "PASS_THROUGH"
    DROP = "DROP"


_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def duration_seconds(text: str) -> int:
    """Seconds in a fixed-length duration such as ``"1 hour"`` or ``"2 minutes"``."""
    m = re.fullmatch(r"\s*(\d+)\s+(second|minute|hour|day)s?\s*", text.lower())
    if not m or int(m.group(1)) == 0:
        raise ValueError(f"not a fixed-length positive duration: {text!r}")
    return int(m.group(1)) * _UNITS[m.group(2)]


@dataclass(frozen=True)
class MeteringConfig:
    window: str = "1 hour"
    aggregations: Mapping[str, str] = field(default_factory=lambda: dict(DEFAULT_AGGREGATIONS))
    split_keys: Mapping[str, str] = field(default_factory=dict)
    missing_key: Mapping[str, MissingKey | str] = field(default_factory=dict)
    fallback_principal: str = "unknown"
    principal_tags: tuple[str, ...] = ("principal_id",)
    watermark: str = "0 seconds"

    def __post_init__(self):
        duration_seconds(self.window)
        for metric, kind in self.aggregations.items():
            if kind.upper() not in AggregationType.__members__:
                raise ValueError(
                    f"invalid aggregation type {kind!r} for metric {metric!r}, "
                    f"expected one of {sorted(AggregationType.__members__)}"
                )
        for metric, policy in self.missing_key.items():
            MissingKey(policy)

    def aggregation_of(self, metric: str) -> AggregationType:
        return AggregationType(self.aggregations.get(metric, "SUM").upper())

    @property
    def max_metrics(self) -> list[str]:
        return sorted(m for m, k in self.aggregations.items() if k.upper() == "MAX")

    def policy_of(self, metric: str) -> MissingKey:
        return MissingKey(self.missing_key.get(metric, MissingKey.ASSIGN_TO_FALLBACK))

    @property
    def gauge_timeout(self) -> timedelta:
        """A gauge is gone when not updated for one window plus half a minute."""
        return timedelta(seconds=duration_seconds(self.window) + 30)
