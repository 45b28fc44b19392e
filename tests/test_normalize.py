from datetime import datetime

import pytest
from helpers import raw
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark import MeteringConfig
from tallyspark.functions import normalize as N
from tallyspark.functions.buckets import bucket_seconds, bucket_start
from tallyspark.sources.raw import corrupt_raw, parse_raw, read_pages, read_raw, valid_raw


@pytest.mark.parametrize(
    "fields, expected",
    [
        ({"gauge": "7.25", "a_first": "80"}, 7.25),
        ({"counter": "-3", "a_first": "80"}, -3.0),
        ({"counter": "41", "gauge": "0.5"}, 0.5),
        ({"z_spread": "2", "a_centre": "64"}, 64.0),
        ({}, 0.0),
        ({"gauge": "many"}, 0.0),
        ({"gauge": None, "a": "3"}, 0.0),
        (None, 0.0),
    ],
)
def test_value_selection(spark, fields, expected):
    df = raw(spark, [("2024-01-01T00:00:00", "m", fields, {})])
    assert df.select(N.metric_value(F.col("fields"))).first()[0] == expected


def test_entities(spark):
    at = "2024-01-01T00:00:00"
    df = raw(
        spark,
        [
            (at, "m", {}, {"topic": "t", "principal_id": "p"}),
            (at, "m", {}, {"principal_id": "p"}),
            (at, "m", {}, {"env": "dev"}),
            (at, "m", {}, {"topic": None}),
            (at, None, {}, {"topic": "t"}),
        ],
    )
    got = [(r.entity_type, r.name) for r in N.normalize(df).collect()]
    assert sorted(got) == [("PRINCIPAL", "p"), ("TOPIC", "t"), ("UNKNOWN", "")]


def test_other_principal_tag(spark):
    df = raw(spark, [("2024-01-01T00:00:00", "m", {}, {"principal": "p"})])
    assert N.normalize(df, ("principal_id", "principal")).first().name == "p"


def test_names_and_subjects(spark):
    row = spark.range(1).select(
        N.normalize_metric_name(F.lit("io.vendor.server/sent_bytes")).alias("a"),
        N.normalize_metric_name(F.lit("a_ratio_b")).alias("b"),
        N.subject_topic(F.lit("plum-value-key")).alias("c"),
        N.subject_topic(F.lit("plum-key-value")).alias("d"),
        N.is_topic_subject(F.lit("Orchard")).alias("e"),
        N.price_per_gb(F.lit("x_bytes"), F.lit(0.00000000010058284)).alias("f"),
        N.price_per_gb(F.lit("x_count"), F.lit(1.0)).alias("g"),
    ).first()
    assert tuple(row) == ("vendor_server_sent_bytes", "a_ratb", "plum-value", "plum", False, 0.108, None)


def test_instants(spark):
    row = spark.range(1).select(
        N.parse_instant(F.lit("1999-12-31T23:30:05.25Z")).alias("a"),
        N.parse_instant(F.lit("1999/12/31 23:30")).alias("b"),
        N.parse_instant(F.lit("2000-01-01T01:00:00+05:30")).alias("o"),
        N.epoch_to_instant(F.lit("86400.5"), "seconds").alias("c"),
        N.epoch_to_instant(F.lit("86400007"), "millis").alias("d"),
        N.last_full_hour(F.lit("1984-02-29 13:00:00").cast("timestamp"))[0].alias("e"),
    ).first()
    assert row.a == datetime(1999, 12, 31, 23, 30, 5, 250000) and row.b is None
    assert row.o == datetime(1999, 12, 31, 19, 30)
    assert row.c == datetime(1970, 1, 2, 0, 0, 0, 500000) and row.d == datetime(1970, 1, 2, 0, 0, 0, 7000)
    assert row.e == datetime(1984, 2, 29, 12)


def test_raw_json(spark, tmp_path):
    good = '{"timestamp":951782400,"tags":{"topic":"leap"},"name":"m","fields":{"gauge":12.5}}'
    (tmp_path / "a").write_text(f"{good}\n{{broken\n")
    (tmp_path / "b").write_text('{"fields":{},"name":"n","tags":{},"timestamp":"2024-01-01T00:00:00Z"}\n')
    rows = {r.name: r for r in read_raw(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).collect()}
    assert rows["m"].fields == {"gauge": "12.5"} and rows["m"].event_time == datetime(2000, 2, 29)
    assert rows["n"].timestamp == datetime(2024, 1, 1)
    parsed = parse_raw(spark.read.text(str(tmp_path)))
    assert corrupt_raw(parsed).count() == 1 and valid_raw(parsed).count() == 2
    (tmp_path / "b").write_text('{"name":"n","timestamp":"yesterday"}\n{"name":"n"}\n')
    assert read_raw(spark, str(tmp_path), corrupt=True).count() == 3 and read_raw(spark, str(tmp_path)).count() == 1
    with pytest.raises(ValueError):
        read_raw(spark)


def test_missing_pages_are_empty(spark, tmp_path):
    assert read_pages(spark, str(tmp_path / "none"), "m", "metric.topic", "c").count() == 0


def test_config_is_checked():
    assert MeteringConfig(aggregations={"m": "max"}).aggregation_of("m").value == "MAX"
    assert MeteringConfig().aggregation_of("other").value == "SUM"
    for bad in (
        {"aggregations": {"m": "median"}},
        {"missing_key": {"m": "KEEP"}},
        {"window": "1 month"},
        {"window": "0 seconds"},
    ):
        with pytest.raises(ValueError):
            MeteringConfig(**bad)


def test_bucket_width():
    a = datetime(2024, 1, 1)
    assert bucket_seconds(a, datetime(2024, 1, 1, 5)) == 3600
    assert bucket_seconds(a, datetime(2024, 1, 8)) == 7 * 3600
    assert bucket_seconds(a, datetime(2024, 3, 1)) == 24 * 3600
    assert bucket_seconds(a, datetime(2024, 1, 2), 48) == 86400
    assert bucket_seconds(a, datetime(2024, 1, 1, 0, 30), 0) == 1


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(0, 10**9), min_size=1, max_size=20), st.integers(1, 10**6))
def test_buckets_are_aligned(spark, offsets, width):
    origin = datetime(2024, 1, 1)
    df = spark.createDataFrame([(o,) for o in offsets], "o BIGINT")
    base = F.lit(1704067200)
    at = F.timestamp_seconds(base + F.col("o"))
    got = df.select("o", (F.unix_seconds(bucket_start(at, origin, width)) - base).alias("b")).collect()
    assert all(r.b == r.o // width * width for r in got)
