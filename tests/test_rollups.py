"""Roll-ups kept up to date beside a fact table."""

import random
from collections import defaultdict
from datetime import date, datetime, timedelta

from helpers import facts

from tallyspark.config import MeteringConfig
from tallyspark.operators.windows import rollup
from tallyspark.sources import facts as S
from tallyspark.sources import rollups as RO

CONFIG = MeteringConfig(aggregations={"peak": "max"})


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def windows(spark, rows):
    """rows: (day, hour, metric, value, app)"""
    at = lambda d, h: (datetime(2024, 1, 1) + timedelta(days=d, hours=h)).isoformat()
    return facts(spark, [(at(d, h), at(d, h + 1), m, v, {"app": app} if app else {}, "t", "TOPIC") for d, h, m, v, app in rows])


def test_three_upserts_equal_the_full_rollup(spark, tmp_path):
    rng = random.Random(5)
    store = S.FactTable(spark, str(tmp_path / "f"), chunk_days=5)
    tables = {unit: RO.RollupTable(store, str(tmp_path / unit), unit, CONFIG, ["app", "day"]) for unit in ("hour", "week", "month")}
    assert all(t.refresh() == [] and t.read().count() == 0 for t in tables.values())
    for days in (range(60), range(20, 33), (2, 58)):
        keys = {(d, rng.randint(0, 3), m, app) for d in days for m in ("peak", "sent") for app in ("a", "b", None)}
        store.upsert(windows(spark, [(d, h, m, rng.randint(-9, 9), app) for d, h, m, app in keys]))
        for unit, table in tables.items():
            table.refresh()
            assert rows_of(table.read().na.fill("-")) == rows_of(rollup(store.read(), unit, CONFIG, ["app", "day"]).na.fill("-"))
    fresh = tables["week"].compacted(str(tmp_path / "fresh"))
    assert rows_of(fresh.read().na.fill("-")) == rows_of(tables["week"].read().na.fill("-"))
    assert fresh.refresh() == []


def test_a_lowered_maximum_and_a_moved_label_leave_nothing_behind(spark, tmp_path):
    store = S.FactTable(spark, str(tmp_path / "f"), key=S.WINDOW_KEY)
    table = RO.RollupTable(store, str(tmp_path / "r"), "month", CONFIG, ["app"])
    store.upsert(windows(spark, [(0, 0, "peak", 9, "a"), (0, 1, "peak", 4, "a"), (1, 0, "sent", 5, "a")]))
    table.refresh()
    store.upsert(windows(spark, [(0, 0, "peak", 1, "a"), (1, 0, "sent", 6, "b")]))
    table.refresh()
    got = [(r.initial_metric_name, r.app, r.value) for r in table.read().collect()]
    assert sorted(got) == [("peak", "a", 4.0), ("sent", "b", 6.0)]


def test_a_refresh_reads_only_the_chunks_of_changed_days(spark, tmp_path):
    store = S.FactTable(spark, str(tmp_path / "f"), chunk_days=3)
    table = RO.RollupTable(store, str(tmp_path / "r"), "month", CONFIG)
    store.upsert(windows(spark, [(d, 0, "sent", d, None) for d in range(30)]))
    assert table.refresh() == [(date(2024, 1, 1), date(2024, 1, 30))]
    store.upsert(windows(spark, [(d, 0, "sent", 0, None) for d in (4, 5, 17)]))
    ranges = table.refresh()
    assert ranges == [(date(2024, 1, 5), date(2024, 1, 6)), (date(2024, 1, 18), date(2024, 1, 18))]
    read = store.versions().filter(RO.in_days(ranges))
    plan = read._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "FileScan parquet" in x)
    assert "chunk_start" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "start_time" in scan.split("PushedFilters")[1]
    assert read.select("start_time").distinct().count() == 3
    assert spark.read.parquet(f"{tmp_path}/r/version=2").count() == 3


def test_a_folder_without_its_mark_is_made_again(spark, tmp_path):
    store = S.FactTable(spark, str(tmp_path / "f"))
    table = RO.RollupTable(store, str(tmp_path / "r"), "day", CONFIG)
    for value in (1, 2):
        store.upsert(windows(spark, [(0, 0, "sent", value, None)]))
        table.refresh()
    (tmp_path / "r" / "version=2" / "_SUCCESS").unlink()
    assert [r.value for r in table.read().collect()] == [1.0]
    assert table.refresh() and [r.value for r in table.read().collect()] == [2.0]


def test_many_ranges_are_joined_over_the_smallest_gaps(spark):
    days = [3 * i + (100 if i > 80 else 0) for i in range(100)]
    rows = spark.createDataFrame([(datetime(2024, 1, 1) + timedelta(d),) for d in days] + [(None,)], "start_time TIMESTAMP")
    ranges = RO.changed_days(rows)
    assert len(ranges) == RO.MAX_RANGES
    inside = lambda d: sum(a <= date(2024, 1, 1) + timedelta(d) <= b for a, b in ranges)
    assert all(inside(d) == 1 for d in days) and inside(290) == 0
    held = defaultdict(int)
    for a, b in ranges:
        held[(b - a).days % 3] += 1
    assert set(held) == {0}
