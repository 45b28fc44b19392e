"""Linear pricing of windowed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators.asof import as_of

# Metric, base cost, cost factor of the sample price book.
DEFAULT_PRICE_BOOK = (
    ("confluent_kafka_server_response_bytes", 0.0, 0.0),
    ("confluent_kafka_server_sent_bytes", 0.0, 0.00000000010058284),
    ("confluent_kafka_server_request_bytes", 0.0, 0.0),
    ("confluent_kafka_server_received_bytes", 0.0, 0.00000000004703484),
    ("confluent_kafka_server_received_records", 0.0, 0.0),
    ("confluent_kafka_server_request_count", 0.0, 0.0),
    ("confluent_kafka_server_partition_count", 0.0, 0.0),
    ("confluent_kafka_server_successful_authentication_count", 0.0, 0.0),
    ("confluent_kafka_server_consumer_lag_offsets", 0.0, 0.0),
    ("confluent_kafka_server_sent_records", 0.0, 0.0),
    ("confluent_kafka_server_retained_bytes", 0.0, 0.00000000000012293458),
    ("confluent_kafka_server_active_connection_count", 0.0, 0.0),
    ("confluent_kafka_server_cluster_load_percent", 0.0, 0.0),
)


def default_price_book(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(DEFAULT_PRICE_BOOK), "metric_name STRING, base_cost DOUBLE, cost_factor DOUBLE"
    )


def price(windowed: DataFrame, prices: DataFrame) -> DataFrame:
    """cost = base + factor x value by the current rule of the metric; no rule, no cost."""
    rule = prices.select(F.col("metric_name").alias("_metric"), "base_cost", "cost_factor")
    return (
        windowed.drop("cost")
        .join(rule, F.col("initial_metric_name") == F.col("_metric"), "left")
        .withColumn("cost", F.col("base_cost") + F.col("cost_factor") * F.col("value"))
        .drop("_metric", "base_cost", "cost_factor")
    )


def backtest_prices(windowed: DataFrame, changelog: DataFrame) -> DataFrame:
    """Price every window by the version in force at its start; before the first one there is no cost.

    A metric that holds most of the windows is spread over slices of time (:func:`as_of`).
    """
    versions = changelog.select(F.col("metric_name").alias("initial_metric_name"), "creation_time", F.col("base_cost").alias("_base"), F.col("cost_factor").alias("_factor"))
    found = as_of(windowed.drop("cost"), versions, ["initial_metric_name"], "start_time", "creation_time", ["_base", "_factor"], "30 days")
    return found.withColumn("cost", F.col("_base") + F.col("_factor") * F.col("value")).drop("_base", "_factor")


def base_charge(facts: DataFrame, charge_per_hour: float) -> DataFrame:
    """A fixed amount per principal and active hour, whatever it used."""
    return (
        facts.filter(F.col("entity_type") == "PRINCIPAL")
        .groupBy(F.col("name").alias("principal"), F.date_trunc("hour", "start_time").alias("hour"))
        .agg(F.lit(float(charge_per_hour)).alias("cost"))
    )
