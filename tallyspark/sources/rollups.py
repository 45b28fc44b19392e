"""Roll-ups that follow a fact table: partial results of each day, replaced when its facts change."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.config import MeteringConfig
from tallyspark.operators.windows import reduced_value
from tallyspark.sources.facts import FactTable, matching

MAX_RANGES = 64  # ranges of changed days in one filter; beyond that the nearest ones are joined


class RollupTable:
    """Facts per hour, day, week or month, kept beside ``store`` in plain Parquet.

    A refresh reads which days the new versions touch, aggregates the current facts of those days
    anew and writes them as one folder; the chunks of other days are not read. A replaced fact is
    thereby taken back exactly, from a maximum too, and sums don't drift as they would by adding
    differences. Readers take the newest version of each day and merge the days of a period.

    The key of the store has to hold ``start_time``, as both of its keys do, so that all versions
    of a fact lie in one day. A folder without its completion mark is not read, and the next
    refresh does its work again. Facts have a start; one without is in no roll-up.
    """

    def __init__(self, store: FactTable, path: str, unit: str, config: MeteringConfig, keys: Sequence[str] = ()):
        self.store, self.path, self.unit, self.config, self.keys = store, path.rstrip("/"), unit, config, list(keys)
        # the names of labels are free, so that those of the columns are positions
        self._labels = [f"key_{i}" for i in range(len(self.keys))]
        self._schema = ", ".join(
            ["day DATE, period_start TIMESTAMP, initial_metric_name STRING", *(f"{c} STRING" for c in self._labels), "value DOUBLE, cost DOUBLE, version BIGINT"]
        )

    def newest_version(self) -> int:
        """The version of the store up to which the roll-up is complete; 0 before the first refresh."""
        spark = self.store.spark
        marks = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/version=*/_SUCCESS")
        found = marks.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(marks) or []
        return max((int(f.getPath().getParent().getName().split("=")[1]) for f in found), default=0)

    def refresh(self) -> list[tuple[date, date]]:
        """Bring the roll-up up to the newest version of the store; the ranges of days that were aggregated."""
        done, newest = self.newest_version(), self.store.newest_version()
        if newest <= done:
            return []
        ranges = changed_days(self.store.versions().filter((F.col("version") > done) & (F.col("version") <= newest)))
        rows = self.store.versions().filter((F.col("version") <= newest) & in_days(ranges))
        self._partials(self.store.newest_of(rows)).write.mode("overwrite").parquet(f"{self.path}/version={newest}")
        return ranges

    def read(self) -> DataFrame:
        """(period_start, initial_metric_name, keys, value, cost), as ``rollup`` of all current facts gives them."""
        spark, done = self.store.spark, self.newest_version()
        rows = spark.createDataFrame([], self._schema)
        if done:
            rows = spark.read.schema(self._schema).parquet(self.path).filter(F.col("version") <= done)
        newest = rows.groupBy("day").agg(F.max("version").alias("version"))
        current = matching(rows, newest, ["day", "version"], "left_semi")
        merged = self._reduced(current.groupBy("period_start", "initial_metric_name", *self._labels))
        labels = [F.col(c).alias(k) for c, k in zip(self._labels, self.keys)]
        return merged.select("period_start", "initial_metric_name", *labels, "value", "cost")

    def compacted(self, path: str) -> RollupTable:
        """The newest version of each day as the only one of a table in a fresh folder."""
        table = RollupTable(self.store, path, self.unit, self.config, self.keys)
        done = self.newest_version()
        if done:
            rows = self.store.spark.read.schema(self._schema).parquet(self.path).filter(F.col("version") <= done)
            newest = rows.groupBy("day").agg(F.max("version").alias("version"))
            current = matching(rows, newest, ["day", "version"], "left_semi").drop("version")
            current.write.mode("overwrite").parquet(f"{table.path}/version={done}")
        return table

    def _partials(self, facts: DataFrame) -> DataFrame:
        labels = [F.col("context")[k].alias(c) for c, k in zip(self._labels, self.keys)]
        period = F.date_trunc(self.unit, "start_time").alias("period_start")
        return self._reduced(facts.groupBy(F.to_date("start_time").alias("day"), period, "initial_metric_name", *labels))

    def _reduced(self, groups) -> DataFrame:
        value = reduced_value(self.config, F.col("initial_metric_name"), F.col("value"))
        return groups.agg(value.alias("value"), F.sum("cost").alias("cost"))


def changed_days(rows: DataFrame) -> list[tuple[date, date]]:
    """Ranges (first, last) of the days of some versions, at most MAX_RANGES of them.

    What the driver gets is one row for each day; the nearest ranges are joined over the days between.
    """
    days = sorted(r.day for r in rows.select(F.to_date("start_time").alias("day")).distinct().collect() if r.day)
    gaps = sorted(((b - a, b) for a, b in zip(days, days[1:]) if b - a > timedelta(1)), reverse=True)[: MAX_RANGES - 1]
    starts = sorted([*days[:1], *(b for _, b in gaps)])
    return [(a, max(d for d in days if d < b)) for a, b in zip(starts, [*starts[1:], date.max])]


def in_days(ranges: Sequence[tuple[date, date]]) -> Column:
    """Facts that start in one of the ranges; prunes chunk folders, and row groups by their start."""
    chunk = start = F.lit(False)
    for first, last in ranges:
        low, high = F.lit(first), F.lit(last)
        chunk = chunk | ((F.date_add("chunk_start", F.col("chunk_days")) > low) & (F.col("chunk_start") <= high))
        start = start | ((F.col("start_time") >= low.cast("timestamp")) & (F.col("start_time") < F.date_add(high, 1).cast("timestamp")))
    return chunk & start
