"""Gauges that follow the fact table: a stream with the last value of each series as its state.

Facts hold a row for each series and window, so a series with very many samples is small here.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallyspark.config import MeteringConfig, duration_seconds
from tallyspark.functions.maps import canonical_json
from tallyspark.operators.gauges import gauge_samples, padded
from tallyspark.session import prepare
from tallyspark.sources.facts import FactTable
from tallyspark.streaming.metering import STATE_STORE

# the processor travels by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHANGES = "name STRING, tags_json STRING, value DOUBLE, last_seen BIGINT, gone BOOLEAN"  # times in microseconds


SLOTS = 1024  # parts of the state; a checkpoint keeps the number that it began with


class LastValues(StatefulProcessor):
    """Keeps the newest sample of each series of a slot and says when one changes or, by a timer, is gone.

    A slot is read, merged and written as a whole, because each call to the state of a key costs as
    much as the work on hundreds of rows.
    """

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getListState("last", "name STRING, tags_json STRING, last_seen BIGINT, version BIGINT, value DOUBLE")

    def _due(self, last_seen: int) -> int:
        """The first millisecond at which a sample of ``last_seen`` is too old."""
        return last_seen // 1000 + self.wait_ms + 1

    def _next(self, series: dict[tuple, tuple]) -> int | None:
        """When the first of the series is gone: the one timer of a slot."""
        return min((self._due(last_seen) for last_seen, *_ in series.values()), default=None)

    def _stored(self) -> dict[tuple, tuple]:
        return {(name, tags): tuple(sample) for name, tags, *sample in self.last.get()}

    def _store(self, series: dict[tuple, tuple]) -> None:
        if series:
            self.last.put([(*key, *sample) for key, sample in series.items()])
        else:
            self.last.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        series, changed = self._stored(), set()
        due = self._next(series)
        age = lambda x: (x[0], x[1], x[2] is not None, x[2])
        for r in rows:
            this, sample = (r.name, r.tags_json), (r.micros, r.version, r.value)
            if this not in series or age(sample) > age(series[this]):
                series[this] = sample
                changed.add(this)
        if not changed:
            return
        self._store(series)
        if self._next(series) != due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(self._next(series))
        for name, tags in changed:
            last_seen, _, value = series[name, tags]
            yield Row(name=name, tags_json=tags, value=value, last_seen=last_seen, gone=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        now, series = timerValues.getCurrentWatermarkInMs(), self._stored()
        left = {this: sample for this, sample in series.items() if self._due(sample[0]) > now}
        self._store(left)
        if left:
            self.handle.registerTimer(self._next(left))
        for (name, tags), (last_seen, _, value) in series.items():
            if (name, tags) not in left:
                yield Row(name=name, tags_json=tags, value=value, last_seen=last_seen, gone=True)

    def close(self) -> None:
        pass


def _seconds(delay: str) -> int:
    return 0 if delay.split()[0] == "0" else duration_seconds(delay)


def gauge_changes(facts: DataFrame, config: MeteringConfig, prefix: str = "") -> DataFrame:
    """CHANGES of the gauges over a stream of fact versions.

    Of samples of one time the later version wins, then the greater value. The watermark waits
    for a window and the delay of the windows themselves, since facts of that age still
    change; timers are that much earlier, so a gauge is gone once the newest event time
    passes its last one by more than the timeout. Older rows are dropped. The state has SLOTS keys,
    each with the series that fall to it.
    """
    slack = duration_seconds(config.window) + _seconds(config.watermark)
    wait = int(config.gauge_timeout.total_seconds()) - slack
    return (
        gauge_samples(facts, prefix, "version")
        .select("name", canonical_json(F.col("tags")).alias("tags_json"), "value", "event_time", F.unix_micros("event_time").alias("micros"), "version")
        .withWatermark("event_time", f"{slack} seconds")
        .withColumn("slot", F.pmod(F.xxhash64("name", "tags_json"), F.lit(SLOTS)).cast("int"))
        .groupBy("slot")
        .transformWithState(LastValues(wait * 1000), CHANGES, "Update", "EventTime")
    )


def start_gauges(
    spark: SparkSession,
    base: str,
    config: MeteringConfig,
    trigger: dict | None = None,
    prefix: str = "",
    max_files: int | None = None,
) -> StreamingQuery:
    """Follows ``base/facts``; each batch writes its changes as a folder of ``base/gauges``, a replay its own."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)

    def write(changes: DataFrame, batch_id: int) -> None:
        changes.write.mode("overwrite").parquet(f"{base}/gauges/batch_id={batch_id}")

    return (
        gauge_changes(FactTable(prepare(spark), f"{base}/facts").changes(max_files), config, prefix)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", f"{base}/checkpoints/gauges")
        .trigger(**(trigger or {"processingTime": "15 seconds"}))
        .queryName("tallyspark-gauges")
        .start()
    )


def live_gauges(spark: SparkSession, base: str) -> DataFrame:
    """The gauges that are not gone (name, tags_json, value, last_seen, tags).

    Series of one name have the same tag keys, also those that only a gauge now gone had.
    """
    changes = spark.read.schema(f"{CHANGES}, batch_id BIGINT").parquet(f"{base}/gauges")
    order = F.struct("batch_id", "last_seen", "gone")
    newest = changes.groupBy("name", "tags_json").agg(
        F.max_by("value", order).alias("value"), F.max_by("last_seen", order).alias("last_seen"), F.max_by("gone", order).alias("gone")
    )
    rows = newest.withColumn("last_seen", F.timestamp_micros("last_seen"))
    return padded(rows.filter(~F.col("gone")).drop("gone"), rows)
