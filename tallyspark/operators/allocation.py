"""Distributing totals and bills over context keys."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.discovery import context_keys
from tallyspark.operators.shares import with_group_total
from tallyspark.sources.facts import contained

TABLE_UNKNOWN = "<unknown>"
BILL_OTHER = "<other>"

# Bill line -> the metric it is distributed by.
BILL_METRICS = {
    "storage": "confluent_kafka_server_retained_bytes",
    "network_read": "confluent_kafka_server_request_bytes",
    "network_write": "confluent_kafka_server_response_bytes",
}
SMALLEST_EDGE_CENTS = 10
MISMATCH_TOLERANCE = 0.01


def share_table(
    facts: DataFrame, start: datetime | None, end: datetime | None, keys: Sequence[str]
) -> DataFrame:
    """(metric, key1..n, total, percentage): percentage is the share of the metric's total."""
    labels = [F.col("context")[k].alias(k) for k in keys]
    grouped = (
        facts.filter(contained(start, end))
        .groupBy(F.col("initial_metric_name").alias("metric"), *labels)
        .agg(F.sum("value").alias("total"))
    )
    return with_group_total(grouped, ["metric"], "total").select(
        "metric",
        *[F.coalesce(F.col(k), F.lit(TABLE_UNKNOWN)).alias(k) for k in keys],
        "total",
        F.try_divide("total", "group_total").alias("percentage"),
    )


def write_share_csv(table: DataFrame, keys: Sequence[str], path: str) -> None:
    """CSV with header; cells are quoted where needed and ordered by the context keys."""
    renamed = table.select(
        F.col("metric").alias("Metric"),
        *keys,
        F.col("total").alias("Total"),
        F.col("percentage").alias("Percentage"),
    )
    (
        renamed.orderBy(*keys, "Metric")
        .write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .csv(path)
    )


def default_bills(bills_wide: DataFrame, bill_metrics: dict | None = None) -> DataFrame:
    """Wide bills (currency) to long ones (metric, cents); open periods become last month."""
    lines = bill_metrics or BILL_METRICS
    today = F.current_date()
    first = F.add_months(F.trunc(today, "month"), -1).cast("timestamp")
    last = F.last_day(F.add_months(today, -1)).cast("timestamp")
    cents = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(metric).alias("metric"),
                    F.round(F.coalesce(F.col(line), F.lit(0.0)) * 100).cast("bigint").alias("cents"),
                )
                for line, metric in lines.items()
            ]
        )
    )
    return bills_wide.select(
        "bill_id",
        F.coalesce("period_from", first).alias("period_from"),
        F.coalesce("period_to", last).alias("period_to"),
        cents.alias("_line"),
    ).select("bill_id", "period_from", "period_to", "_line.metric", "_line.cents")


def allocate_bill(facts: DataFrame, bills: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Each bill line split over the key groups of its metric by their share of usage.

    A row is named by the last key; equal names are not merged. Lines without cents and
    metrics without usage yield nothing. No keys named means all keys of the facts, in
    alphabetical order; their names, not their values, are collected.
    """
    keys = list(keys) or [r.context_key for r in context_keys(facts).collect()]
    if not keys:
        raise ValueError("the facts have no context key to allocate by")
    lines = bills.filter(F.col("cents").isNotNull() & (F.col("cents") != 0)).withColumnRenamed(
        "metric", "_metric"
    )
    labels = [F.col("context")[k].alias(k) for k in keys]
    # facts shrink to windows x key groups before they meet the bills
    usage = facts.groupBy(
        F.col("initial_metric_name").alias("metric"), "start_time", "end_time", *labels
    ).agg(F.sum("value").alias("value"))
    # one row per bill line and day makes the range an equi-join: usage meets only the bills
    # of its own day, not every bill of its metric
    days = F.sequence(F.to_date("period_from"), F.to_date("period_to"))
    lines = lines.filter(F.col("period_from") <= F.col("period_to")).withColumn(
        "_day", F.explode(days)
    )
    inside = (F.col("start_time") >= F.col("period_from")) & (F.col("end_time") <= F.col("period_to"))
    same_day = (F.col("metric") == F.col("_metric")) & (F.to_date("start_time") == F.col("_day"))
    grouped = (
        usage.join(lines, same_day & inside)
        .groupBy("bill_id", "metric", "cents", *keys)
        .agg(F.sum("value").alias("total"))
    )
    named = with_group_total(grouped, ["bill_id", "metric"], "total").filter("group_total <> 0")
    return named.select(
        "bill_id",
        "metric",
        *[F.coalesce(F.col(k), F.lit(BILL_OTHER)).alias(k) for k in keys],
        F.coalesce(F.col(keys[-1]), F.lit(BILL_OTHER)).alias("name"),
        (F.col("total") / F.col("group_total") * F.col("cents")).alias("price"),
    )


def _line_sum(lines: Sequence[str]) -> Column:
    total = F.lit(0.0)
    for line in lines:
        total = total + F.coalesce(F.col(line), F.lit(0.0))
    return total


def bill_residual(bills_wide: DataFrame) -> DataFrame:
    """What the total contains beyond the distributed lines."""
    total = F.coalesce(F.col("total"), F.lit(0.0))
    return bills_wide.withColumn("other", total - _line_sum(list(BILL_METRICS)))


def bill_mismatch(bills_wide: DataFrame) -> DataFrame:
    total = F.coalesce(F.col("total"), F.lit(0.0))
    gap = F.abs(_line_sum(list(BILL_METRICS)) - total)
    return bills_wide.withColumn("mismatch", (total > 0) & (gap > MISMATCH_TOLERANCE))


def allocation_edges(
    allocation: DataFrame, bills_wide: DataFrame, bill_metrics: dict | None = None
) -> DataFrame:
    """Edges total -> metric, total -> other, metric -> name, in currency. Shares below ten
    cents are not drawn."""
    lines = bill_metrics or BILL_METRICS
    first = [
        F.struct(F.lit(metric).alias("target"), F.coalesce(F.col(line), F.lit(0.0)).alias("value"))
        for line, metric in lines.items()
    ]
    other = F.struct(F.lit("other").alias("target"), F.col("other").alias("value"))
    top = (
        bill_residual(bills_wide)
        .select("bill_id", F.explode(F.array(*first, other)).alias("_e"))
        .select("bill_id", F.lit("total").alias("source"), "_e.target", "_e.value")
    )
    drawn = F.col("price").isNull() | (F.col("price") >= SMALLEST_EDGE_CENTS)
    leaves = allocation.filter(drawn).select(
        "bill_id",
        F.col("metric").alias("source"),
        F.col("name").alias("target"),
        (F.coalesce("price", F.lit(0.0)) / 100).alias("value"),
    )
    return top.unionByName(leaves)


def aggregated_export(
    facts: DataFrame, start: datetime | None, end: datetime | None, key: str, metrics: Sequence[str]
) -> DataFrame:
    """One row per label; per metric its sum and its percentage of the metric's total.

    A label without a metric gets a null cell. ``metrics`` names the columns, so no extra
    job is needed to find them.
    """
    label = F.coalesce(F.col("context")[key], F.lit("unknown")).alias(key)
    grouped = (
        facts.filter(contained(start, end) & F.col("initial_metric_name").isin(list(metrics)))
        .groupBy(label, "initial_metric_name")
        .agg(F.sum("value").alias("value"))
    )
    shares = with_group_total(grouped, ["initial_metric_name"], "value").withColumn(
        "percent", F.round(F.try_divide("value", "group_total") * 100, 2)
    )
    return shares.groupBy(key).agg(
        *[
            F.max(F.when(F.col("initial_metric_name") == m, F.col(c))).alias(f"{m} [{unit}]")
            for m in metrics
            for c, unit in (("value", "bytes"), ("percent", "%"))
        ]
    )


def export_aggregated(facts, path: str, start, end, key: str, metrics: Sequence[str]) -> None:
    table = aggregated_export(facts, start, end, key, metrics)
    table.orderBy(key).write.mode("overwrite").option("header", True).csv(path)


def unit_category_summary(
    facts: DataFrame, unit_key: str, category: Column, period: str = "month"
) -> DataFrame:
    """Cost per unit and category per timespan, with subtotals (null = all)."""
    base = facts.select(
        F.date_trunc(period, "start_time").alias("period_start"),
        F.coalesce(F.col("context")[unit_key], F.lit("unknown")).alias("unit"),
        category.alias("category"),
        "value",
        "cost",
    )
    return base.groupingSets(
        [["period_start", "unit", "category"], ["period_start", "unit"], ["period_start"]],
        "period_start",
        "unit",
        "category",
    ).agg(
        F.sum("value").alias("value"),
        F.sum("cost").alias("cost"),
        F.grouping_id("period_start", "unit", "category").cast("int").alias("level"),
    )


def weighted_share(
    facts: DataFrame,
    key: str,
    write_metric: str,
    read_metric: str,
    write_weight: float = 1.0,
    read_weight: float = 2.4,
) -> DataFrame:
    """Share of the weighted sum of written and read volume per context value."""
    metric = F.col("initial_metric_name")
    weight = F.when(metric == write_metric, write_weight).when(metric == read_metric, read_weight)
    grouped = (
        facts.filter(metric.isin(write_metric, read_metric))
        .groupBy(F.coalesce(F.col("context")[key], F.lit("unknown")).alias("name"))
        .agg(F.sum(F.col("value") * weight).alias("weighted"))
    )
    total = grouped.agg(F.sum("weighted").alias("t")).scalar()
    return grouped.select("name", "weighted", F.try_divide("weighted", total).alias("share"))
