"""Rule and price changelogs: append-only tables of versions, null content deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.maps import literal_map
from tallyspark.operators.labels import list_prices, list_rules
from tallyspark.schemas import PRICES, RULES


def _names(ddl: str) -> list[str]:
    return [p.split()[0] for p in ddl.replace("MAP<STRING, STRING>", "MAP").split(",")]


def rule_saves(rules: DataFrame, version: Column, now: Column | None = None) -> DataFrame:
    """Changelog rows that save rules: a missing id is generated, the server sets the time."""
    return rules.select(
        F.coalesce("rule_id", F.uuid()).alias("rule_id"),
        (F.current_timestamp() if now is None else now).alias("creation_time"),
        *[F.col(c) for c in _names(RULES)[2:]],
        version.alias("version"),
    )


def rule_deletes(ids: DataFrame, version: Column) -> DataFrame:
    """Tombstones for the ids in the first column."""
    types = dict(zip(_names(RULES), ["string", *["timestamp"] * 3, "string", "string", "map<string,string>"]))
    return ids.select(
        F.col(ids.columns[0]).alias("rule_id"),
        *[F.lit(None).cast(types[c]).alias(c) for c in _names(RULES)[1:]],
        version.alias("version"),
    )


def price_saves(prices: DataFrame, version: Column, now: Column | None = None) -> DataFrame:
    return prices.select(
        "metric_name",
        (F.current_timestamp() if now is None else now).alias("creation_time"),
        F.col("base_cost").cast("double").alias("base_cost"),
        F.col("cost_factor").cast("double").alias("cost_factor"),
        version.alias("version"),
    )


def price_deletes(names: DataFrame, version: Column) -> DataFrame:
    return names.select(
        F.col(names.columns[0]).alias("metric_name"),
        F.lit(None).cast("timestamp").alias("creation_time"),
        F.lit(None).cast("double").alias("base_cost"),
        F.lit(None).cast("double").alias("cost_factor"),
        version.alias("version"),
    )


class Changelog:
    """A changelog folder of rules or prices."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "rules"):
        self.spark, self.path, self.kind = spark, path, kind
        self.schema = (RULES if kind == "rules" else PRICES) + ", version BIGINT"

    def append(self, rows: DataFrame) -> None:
        typed = rows.withColumn("version", F.col("version").cast("bigint"))
        typed.write.mode("append").parquet(self.path)

    def changes(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def current(self) -> DataFrame:
        rows = self.changes()
        return list_rules(rows) if self.kind == "rules" else list_prices(rows)


def load_rules_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Rules from a JSON array, or from JSON lines, which Spark can split and read in parallel.

    The context is a list of key and value; later keys win.
    """
    raw = spark.read.schema(
        "id STRING, entityType STRING, regex STRING, validFrom STRING, validUntil STRING, "
        "context ARRAY<STRUCT<key: STRING, value: STRING>>"
    ).json(path, multiLine=not lines)
    entries = F.aggregate(
        "context",
        literal_map({}),
        lambda m, e: F.map_concat(
            F.map_filter(m, lambda k, _: k != e["key"]), F.create_map(e["key"], e["value"])
        ),
    )
    return raw.select(
        F.col("id").alias("rule_id"),
        F.lit(None).cast("timestamp").alias("creation_time"),
        F.try_to_timestamp("validFrom").alias("valid_from"),
        F.try_to_timestamp("validUntil").alias("valid_until"),
        F.col("entityType").alias("entity_type"),
        "regex",
        entries.alias("context"),
    )


def load_prices_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    raw = spark.read.schema("metricName STRING, baseCost DOUBLE, costFactor DOUBLE").json(
        path, multiLine=not lines
    )
    return raw.select(
        F.col("metricName").alias("metric_name"),
        F.col("baseCost").alias("base_cost"),
        F.col("costFactor").alias("cost_factor"),
    )
