from datetime import datetime

import pytest
from helpers import prices, raw, rules
from pyspark.sql import functions as F

from tallyspark import MeteringConfig
from tallyspark.operators import labels as L
from tallyspark.operators import pricing, split, windows
from tallyspark.plans.metering import reprocess, usage_facts, window_floor, windowed_usage

T0 = "2024-01-01T00:00:00"
OLD = "2023-01-01T00:00:00"
both = pytest.mark.parametrize("max_inline", [L.INLINE_RULES, 0], ids=["inline", "joined"])


def topic(at, value, name="topic_1", metric="m"):
    return (at, metric, {"gauge": str(value)}, {"env": "dev", "topic": name})


def run(spark, rows, rule_rows=(), config=MeteringConfig(), price_rows=(), max_inline=L.INLINE_RULES):
    compiled = L.compile_rules(rules(spark, list(rule_rows)), max_inline)
    return usage_facts(raw(spark, rows), compiled, prices(spark, list(price_rows)), config).collect()


def test_sum_by_default_max_when_configured(spark):
    values = [6.5, 2.0, 11.0]
    rows = [topic(f"2024-01-01T00:{20 * i:02}:00", v) for i, v in enumerate(values)]
    assert run(spark, rows)[0].value == sum(values)
    assert run(spark, rows, config=MeteringConfig(aggregations={"m": "max"}))[0].value == max(values)


def test_price_is_linear_on_the_window(spark):
    rows = [topic(T0, 40), topic("2024-01-01T00:59:59", 2), topic(T0, 7, metric="gift")]
    got = {r.initial_metric_name: r for r in run(spark, rows, price_rows=[("m", 2.5, 0.25)])}
    assert got["m"].cost == pytest.approx(2.5 + 42 * 0.25) and got["gift"].cost is None
    assert got["m"].tags == "{}"


def test_tumbling_windows(spark):
    minutes = [0, 59, 60, 119, 121, 300]
    rows = [topic(f"2024-01-01T{m // 60:02}:{m % 60:02}:00", 2**i) for i, m in enumerate(minutes)]
    got = sorted((r.start_time.hour, r.end_time.hour, r.value) for r in run(spark, rows))
    assert got == [(0, 1, 3.0), (1, 2, 12.0), (2, 3, 16.0), (5, 6, 32.0)]


def test_two_minute_windows(spark):
    rows = [topic(T0, 1), topic("2024-01-01T00:01:59", 1), topic("2024-01-01T00:02:00", 1)]
    assert sorted(r.value for r in run(spark, rows, config=MeteringConfig(window="2 minutes"))) == [1, 2]


def test_window_by_arrival_validity_by_payload(spark):
    at, payload = "2024-03-01T10:00:00", "2023-12-01T00:00:00"
    rows = [(at, "m", {"gauge": "1"}, {"topic": "t"}, payload)]
    rule_rows = [
        ("1", OLD, None, "2024-01-01T00:00:00", "TOPIC", "t", {"k": "before"}),
        ("2", OLD, "2024-01-01T00:00:00", None, "TOPIC", "t", {"k": "after"}),
    ]
    (got,) = run(spark, rows, rule_rows)
    assert got.start_time == datetime(2024, 3, 1, 10) and got.context == {"k": "before"}


@both
def test_context_change_inside_a_window_makes_two_rows(spark, max_inline):
    change = "2024-01-01T00:30:00"
    rule_rows = [
        ("1", OLD, None, change, "TOPIC", "t", {"k": "a"}),
        ("2", OLD, change, None, "TOPIC", "t", {"k": "b"}),
    ]
    rows = [topic(f"2024-01-01T00:{m:02}:00", 1, "t") for m in (0, 10, 29, 30, 50)]
    got = run(spark, rows, rule_rows, max_inline=max_inline)
    assert sorted((r.context["k"], r.value) for r in got) == [("a", 3), ("b", 2)]


def test_unowned_metrics_are_kept(spark):
    got = run(spark, [(T0, "m", {"gauge": "1.5"}, {"env": "dev"})])
    assert [(r.entity_type, r.name, r.value, r.target) for r in got] == [("UNKNOWN", "", 1.5, "unknown")]


SPLIT = {"m": "writers"}
WRITERS = [
    ("w", OLD, None, None, "TOPIC", "topic_1", {"writers": "alice,bob", "readers": "x"}),
    ("p", OLD, None, None, "PRINCIPAL", "alice", {"team": "a", "topic": "overwritten"}),
]


@both
def test_split_divides_among_members(spark, max_inline):
    config = MeteringConfig(split_keys=SPLIT)
    got = run(spark, [topic(T0, 10)], WRITERS, config, max_inline=max_inline)
    assert sorted((r.entity_type, r.name, r.value, tuple(sorted(r.context.items()))) for r in got) == [
        ("PRINCIPAL", "alice", 5.0, (("team", "a"), ("topic", "topic_1"))),
        ("PRINCIPAL", "bob", 5.0, (("topic", "topic_1"),)),
    ]
    assert {r.target for r in got} == {"topic_1"}


@both
def test_missing_key_policies(spark, max_inline):
    rows = [topic(T0, 10, "bare"), topic(T0, 1, "bare", "other")]

    def names(policy):
        config = MeteringConfig(
            split_keys=SPLIT, missing_key={} if policy is None else {"m": policy},
            fallback_principal="fallback-team",
        )
        got = run(spark, rows, WRITERS, config, max_inline=max_inline)
        return sorted((r.initial_metric_name, r.entity_type, r.name, r.value) for r in got)

    other = ("other", "TOPIC", "bare", 1.0)
    assert names(None) == [("m", "PRINCIPAL", "fallback-team", 10.0), other]
    assert names("PASS_THROUGH") == [("m", "TOPIC", "bare", 10.0), other]
    assert names("DROP") == [other]


@pytest.mark.parametrize(
    "text, members",
    [("a,b", ["a", "b"]), ("a,,b", ["a", "", "b"]), ("a,b,,", ["a", "b"]), (",", []), ("", [""]), (",a", ["", "a"]), (" a, b", [" a", " b"])],
)
def test_list_members(spark, text, members):
    assert spark.range(1).select(split.list_members(F.lit(text))).first()[0] == members


def test_split_keeps_the_sum(spark):
    config = MeteringConfig(split_keys=SPLIT)
    rows = [topic(f"2024-01-01T00:00:{i:02}", i, f"topic_{i % 3}") for i in range(40)]
    assert sum(r.value for r in run(spark, rows, WRITERS, config)) == pytest.approx(sum(range(40)))


def test_split_also_divides_cost(spark):
    config = MeteringConfig(split_keys=SPLIT)
    compiled = L.compile_rules(rules(spark, WRITERS))
    df = spark.sql(
        "SELECT timestamp'2024-01-01' AS timestamp, 'TOPIC' AS entity_type, 'topic_1' AS name, "
        "'m' AS initial_metric_name, 10D AS value, 4D AS cost, map('writers', 'alice,bob') AS context"
    )
    got = split.split_among_principals(df, config, compiled).collect()
    assert [r.cost for r in got] == [2.0, 2.0]


def test_reprocess_starts_at_a_window_boundary(spark):
    config = MeteringConfig()
    start = datetime(2024, 1, 1, 1, 30)
    assert window_floor(start, config).replace(tzinfo=None) == datetime(2024, 1, 1, 1)
    rows = [topic(T0, 1), topic("2024-01-01T01:10:00", 2), topic("2024-01-01T01:40:00", 4)]
    args = (raw(spark, rows), rules(spark, []), prices(spark, []), config)
    assert [r.value for r in reprocess(*args, start).collect()] == [6.0]
    assert sorted(r.value for r in reprocess(*args).collect()) == [1.0, 6.0]


def test_materialized_run_is_the_same(spark):
    rows = [topic(f"2024-01-01T00:00:{i:02}", i, f"topic_{i % 3}") for i in range(40)]
    args = (raw(spark, rows), L.compile_rules(rules(spark, WRITERS), 0), MeteringConfig(split_keys=SPLIT))
    key = lambda r: (r.entity_type, r.name, r.context_json, r.value)
    plain = sorted(map(key, windowed_usage(*args).collect()))
    assert plain == sorted(map(key, windowed_usage(*args, materialize=True).collect()))


def test_series_reductions(spark):
    rows = [(f"2024-01-01T00:0{m}:00", "c", {"counter": str(v)}, {"topic": "t"}) for m, v in enumerate((5, 9, 20))]
    df = raw(spark, rows).withColumn("value", F.col("fields")["counter"].cast("double"))
    assert windows.series_max(df, "1 hour").first().value == 20
    assert windows.series_diff(df, "1 hour").first().value == 15
    assert windows.series_diff(df, "12 minutes").orderBy("period_start").first().value == 4


def test_backtest_uses_the_version_in_force(spark):
    changes = spark.sql(
        "SELECT * FROM VALUES ('m', timestamp'2024-01-01', 0D, 1D), ('m', timestamp'2024-02-01', 0D, 2D) "
        "AS t(metric_name, creation_time, base_cost, cost_factor)"
    )
    usage = spark.sql(
        "SELECT * FROM VALUES (timestamp'2023-12-31', 'm', 1D), (timestamp'2024-01-31', 'm', 1D), "
        "(timestamp'2024-02-01', 'm', 1D) AS t(start_time, initial_metric_name, value)"
    )
    got = pricing.backtest_prices(usage, changes).orderBy("start_time").collect()
    assert [r.cost for r in got] == [None, 1.0, 2.0]
