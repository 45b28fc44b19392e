"""Usage metering and cost allocation as Spark DataFrame transformations."""

from tallyspark.config import AggregationType, MeteringConfig, MissingKey

__all__ = ["AggregationType", "MeteringConfig", "MissingKey"]
