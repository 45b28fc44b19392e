from datetime import datetime, timedelta

import pytest
from helpers import facts, ts


from tallyspark import MeteringConfig
from tallyspark.operators import allocation as A
from tallyspark.operators import discovery as D
from tallyspark.operators import gauges as G
from tallyspark.operators import history as HI
from tallyspark.operators import panels as P

T = [f"2024-01-01T{h:02}:00:00" for h in range(24)]


# (hour, crop, field or None, tons)
HARVEST = [
    (0, "rye", "north", 3.0), (0, "oats", "north", 2.0), (0, "oats", None, 0.5),
    (1, "rye", "south", 4.0), (1, "rye", None, 1.5),
    (2, "oats", "south", 5.0),
]


@pytest.fixture(scope="module")
def usage(spark):
    rows = []
    for i, (h, crop, field, tons) in enumerate(HARVEST):
        context = {"crop": crop, **({"field": field} if field else {})}
        rows.append((T[h], T[h + 1], "tons", tons, context, f"cart{i % 4}", "TOPIC"))
    rows.append((T[2], T[3], "rain", 8.0, {}, "gauge", "TOPIC"))
    return facts(spark, rows).cache()


def expected(column, width=1):
    """Sums of HARVEST by crop (1) or field (2) and bucket."""
    out = {}
    for row in HARVEST:
        key = (row[column] or "unknown", row[0] // width * width)
        out[key] = out.get(key, 0) + row[3]
    return out


def grouped(usage, key, width=None, metrics=("tons",)):
    rows = HI.history_grouped(usage, ts(T[0]), ts(T[3]), metrics, key, width).collect()
    return {(r.name, r.time.hour): r.value for r in rows}


def test_history_by_key_and_hour(usage):
    assert grouped(usage, "crop") == expected(1) and grouped(usage, "field") == expected(2)


def test_single_bucket(usage):
    assert grouped(usage, "crop", 3) == expected(1, 3)
    rows = HI.history_single_bucket(usage, ts(T[0]), ts(T[3]), [], "nothing").collect()
    assert [(r.name, r.value) for r in rows] == [("unknown", 24.0)]


def test_range_is_containment(usage):
    inside = HI.history(usage, ts(T[0]), ts(T[1]) - timedelta(seconds=1))
    assert inside.count() == 0
    assert HI.history(usage, ts(T[0]), ts(T[1])).count() == 3
    assert HI.history(usage, ts(T[0]), ts(T[9]), ["rain"]).count() == 1
    assert HI.history(usage).count() == 0  # the last 30 days


def test_series_arrays(usage):
    got = {r.name: r for r in HI.history_series(usage, ts(T[0]), ts(T[9]), ["tons"]).collect()}
    assert got["cart0"]["values"] == [3.0, 1.5] and [t.hour for t in got["cart0"].times] == [0, 1]


def test_series_continue_in_chunks(spark):
    rows = [(f"2024-01-{d:02}T00:00:00", f"2024-01-{d:02}T01:00:00", "m", d, {}, "t", "TOPIC") for d in range(1, 6)]
    got = HI.history_series(facts(spark, rows), ts("2024-01-01"), ts("2024-02-01"), max_points=2)
    assert [r["values"] for r in got.orderBy("chunk").collect()] == [[1, 2], [3, 4], [5]]


def test_a_day_above_the_limit_is_cut(spark):
    """One series of 500 points within a minute, many of them at one instant; chunks keep the order."""
    rows = [(f"2024-01-01T00:00:{i % 7:02}", "2024-01-01T01:00:00", "m", i, {"k": str(i)}, "t", "TOPIC") for i in range(500)]
    rows += [("2024-01-01T00:00:00", "2024-01-01T01:00:00", "m", 1, {}, "other", "TOPIC")]
    got = HI.history_series(facts(spark, rows), ts("2024-01-01"), ts("2024-02-01"), max_points=64).orderBy("name", "chunk").collect()
    assert [len(r["values"]) for r in got] == [1] + [64] * 7 + [52]
    points = [p for r in got[1:] for p in zip(r.times, r["values"])]
    assert points == sorted(points) and len({v for _, v in points}) == 500


def test_totals_and_discovery(usage):
    totals = {r.initial_metric_name: r.total for r in HI.metric_totals(usage, ts(T[0]), ts(T[9])).collect()}
    assert totals == {"tons": 16.0, "rain": 8.0}
    names = {r.metric_name: (r.last_seen.hour, r.aggregation_type) for r in
             D.metric_names(usage, MeteringConfig(aggregations={"rain": "max"})).collect()}
    assert names == {"tons": (3, "SUM"), "rain": (3, "MAX")}
    assert [r[0] for r in D.context_keys(usage).collect()] == ["crop", "field"]
    assert {r[0] for r in D.context_values(usage, "field").collect()} == {"north", "south"}
    assert D.tag_keys(usage).count() == 0 and D.tag_values(usage, "x").count() == 0
    assert {tuple(r.context) for r in D.pick_context(usage, ["field"]).collect()} == {("field",), ()}


def test_shares_sum_to_one(usage):
    rows = A.share_table(usage, ts(T[0]), None, ["crop", "field"]).collect()
    by_metric = {}
    for r in rows:
        by_metric[r.metric] = by_metric.get(r.metric, 0) + r.percentage
    assert by_metric == {"tons": pytest.approx(1), "rain": pytest.approx(1)}
    assert {(r.crop, r.field) for r in rows if r.metric == "rain"} == {("<unknown>", "<unknown>")}


BILL = "bill_id STRING, period_from TIMESTAMP, period_to TIMESTAMP, "


def test_bill_allocation(spark, usage):
    bills = spark.createDataFrame(
        [
            ("b", ts(T[0]), ts(T[2]), "tons", 600),
            ("b", ts(T[0]), ts(T[2]), "rain", 100),  # no usage in the period
            ("c", ts(T[0]), ts(T[9]), "tons", 0),
            ("d", ts(T[0]), ts(T[1]), "tons", 300),
        ],
        BILL + "metric STRING, cents BIGINT",
    )
    rows = A.allocate_bill(usage, bills, ["crop", "field"]).collect()
    assert sum(r.price for r in rows if r.bill_id == "b") == pytest.approx(600)
    assert sum(r.price for r in rows if r.bill_id == "d") == pytest.approx(300)
    assert {r.bill_id for r in rows} == {"b", "d"}
    names = sorted(r.name for r in rows if r.bill_id == "b")
    assert names == ["<other>", "<other>", "north", "north", "south"]
    by_all = A.allocate_bill(usage, bills).collect()
    assert sorted(map(str, by_all)) == sorted(map(str, rows))
    with pytest.raises(ValueError):
        A.allocate_bill(usage.filter("initial_metric_name = 'rain'"), bills)


def test_panels_show_a_week_unless_told(usage):
    start, end = P.panel_range(None, None)
    assert end - start == timedelta(days=7)
    assert P.panel_range(ts(T[0]), ts(T[1])) == (ts(T[0]), ts(T[1]))


def test_bill_defaults_edges_and_check(spark):
    wide = spark.createDataFrame(
        [("b", None, None, 10.0, 5.0, None, 20.0), ("ok", None, None, 1.0, 1.0, 1.0, 3.005)],
        BILL + "storage DOUBLE, network_read DOUBLE, network_write DOUBLE, total DOUBLE",
    )
    lines = A.default_bills(wide).filter("bill_id = 'b'").collect()
    assert {r.metric.split("_")[-2]: r.cents for r in lines} == {"retained": 1000, "request": 500, "response": 0}
    first = (datetime.now().replace(day=1) - timedelta(days=1)).replace(day=1)
    assert lines[0].period_from.date() == first.date() and lines[0].period_to.month == first.month
    checks = {r.bill_id: (r.other, r.mismatch) for r in A.bill_mismatch(A.bill_residual(wide)).collect()}
    assert checks["b"] == (5.0, True) and checks["ok"][1] is False
    shares = spark.createDataFrame(
        [("b", "m", "big", 10.0), ("b", "m", "small", 9.99), ("b", "m", "odd", None)],
        "bill_id STRING, metric STRING, name STRING, price DOUBLE",
    )
    edges = A.allocation_edges(shares, wide.filter("bill_id = 'b'")).collect()
    assert {(e.source, e.target): e.value for e in edges if e.source == "m"} == {("m", "big"): 0.1, ("m", "odd"): 0.0}
    assert {e.target: e.value for e in edges if e.source == "total"}["other"] == 5.0


def test_aggregated_export_has_null_cells(usage):
    rows = {r["crop"]: r for r in A.aggregated_export(usage, ts(T[0]), ts(T[9]), "crop", ["tons", "rain"]).collect()}
    assert rows["oats"]["tons [bytes]"] == 7.5 and rows["oats"]["tons [%]"] == 46.88
    assert rows["oats"]["rain [bytes]"] is None and rows["unknown"]["rain [%]"] == 100.0


def test_series_shapes(spark):
    hist = spark.createDataFrame(
        [(ts(T[0]), "a", 1.0), (ts(T[0]), "b", 3.0), (ts(T[1]), "a", 0.0), (ts(T[1]), "b", 2.0)],
        "time TIMESTAMP, name STRING, value DOUBLE",
    )
    matrix = P.series_matrix(hist).orderBy("time").collect()
    assert [tuple(r)[1:] for r in matrix] == [(1.0, 3.0), (None, 2.0)]
    shares = {(r.time.hour, r.name): r.percent for r in P.normalize_series(hist).collect()}
    assert shares == {(0, "a"): 25.0, (0, "b"): 75.0, (1, "b"): 100.0}
    assert {r.name: r.total for r in P.series_totals(hist).collect()} == {"a": 1.0, "b": 5.0}
    assert P.series_csv(hist).first().line == "2024-01-01T00:00:00Z,a,1.0"


def test_gaps_repeat_the_value_before(spark):
    hist = spark.createDataFrame([("a", ts(T[0]), 1.0), ("a", ts(T[3]), 2.0)], "name STRING, time TIMESTAMP, value DOUBLE")
    got = P.fill_gaps(hist).orderBy("time").collect()
    assert [(r.value, r.is_filled) for r in got] == [(1, False), (1, True), (1, True), (2, False)]


def test_long_series_fill_over_slices(spark):
    """30 days of one series with holes, null values and a lone point; every step is there once."""
    from datetime import timedelta

    first = ts("2024-01-01T00:00:00")
    kept = [h for h in range(0, 24 * 90 + 1) if h % 17 in (0, 5) or h == 24 * 90]
    rows = [("long", first + timedelta(hours=h), float(h) if h % 34 else None) for h in kept] + [("lone", first, 4.0)]
    hist = spark.createDataFrame(rows, "name STRING, time TIMESTAMP, value DOUBLE")
    got = {(r.name, r.time): (r.value, r.is_filled) for r in P.fill_gaps(hist, slice_width="2 days").collect()}
    assert len(got) == 24 * 90 + 2 and got["lone", first] == (4.0, False)
    value, known = None, {t: v for n, t, v in rows if n == "long"}
    for h in range(24 * 90 + 1):
        t = first + timedelta(hours=h)
        value = value if known.get(t) is None else known[t]
        assert got["long", t] == (value, known.get(t) is None)


def samples(spark, rows):
    data = [(n, tags, float(v), ts(t)) for n, tags, v, t in rows]
    return spark.createDataFrame(data, "name STRING, tags MAP<STRING,STRING>, value DOUBLE, event_time TIMESTAMP")


def test_gauges_widen_to_common_keys(spark):
    df = samples(
        spark,
        [
            ("g", {"topic": "a"}, 1, T[0]),
            ("g", {"topic": "a"}, 2, T[1]),
            ("g", {"topic": "b", "app": "x"}, 3, T[0]),
            ("g", {"topic": "a", "app": ""}, 9, T[2]),
            ("h", {"topic": "a"}, 4, T[0]),
        ],
    )
    got = {(r.name, r.tags_json): r.value for r in G.gauge_snapshot(df).collect()}
    assert got == {
        ("g", '{"app":"","topic":"a"}'): 9.0,
        ("g", '{"app":"x","topic":"b"}'): 3.0,
        ("h", '{"topic":"a"}'): 4.0,
    }


def test_gauges_expire_after_a_window_and_half_a_minute(spark):
    df = samples(
        spark,
        [("g", {"t": "old"}, 1, "2024-01-01T00:59:29"), ("g", {"t": "edge"}, 1, "2024-01-01T00:59:30"),
         ("g", {"t": "new"}, 1, "2024-01-01T02:00:00")],
    )
    active = G.active_gauges(G.gauge_snapshot(df), MeteringConfig()).collect()
    assert sorted(r.tags["t"] for r in active) == ["edge", "new"]


def test_entity_tag_wins_over_context(spark):
    rows = facts(spark, [(T[0], T[1], "m", 1, {"topic": "from-context", "app": "a"}, "t", "TOPIC")])
    got = G.gauge_samples(rows, "usage_").first()
    assert got.tags == {"topic": "t", "app": "a"} and got.name == "usage_m"


def test_panels(spark):
    df = samples(
        spark,
        [
            ("g", {"principal": "p", "topic": "a"}, 1, T[0]),
            ("g", {"principal": "p", "topic": "a"}, 3, T[1]),
            ("g", {"principal": "p", "topic": "b"}, 4, T[1]),
            ("g", {"principal": "q", "topic": "a"}, 1, T[1]),
            ("g", {"principal": "unknown", "topic": "a"}, 50, T[1]),
            ("h", {"principal": "p", "topic": "a"}, 99, T[1]),
        ],
    )
    sums = P.panel_by(df, "g", "principal", "sum", where=P.known_principal()).collect()
    assert {r.principal: r.value for r in sums} == {"p": 7.0, "q": 1.0}
    tops = P.panel_by(df, "g", "topic", "max", datetime(2024, 1, 1, 0), "2 minutes").collect()
    assert {r.topic: r.value for r in tops} == {"a": 1.0}
    assert P.panel_share(df, "g", "p").first().share == 0.875
    assert {r.label for r in P.label_values(df, "principal").collect()} == {"p", "q", "unknown"}
