import json
from datetime import datetime

from helpers import raw
from pyspark.sql import functions as F

from tallyspark.functions import normalize as N
from tallyspark.operators import feeders as FE
from tallyspark.sources.raw import read_pages

AT = "2024-01-01T00:00:00"


def at():
    return F.lit("2024-01-01").cast("timestamp")


def test_schema_counts(spark):
    subjects = spark.createDataFrame(
        [("pears-key", 4), ("pears-value", 7), ("pears-key", 5), ("pears-key", 4), ("figs-value", 2), ("Grove", 9)],
        "subject STRING, version INT",
    )
    got = FE.schema_counts(subjects, at(), {"kafka_id": "c"}).collect()
    assert {r.tags["topic"]: r.fields["gauge"] for r in got} == {"pears": "3", "figs": "1"}
    assert {r.tags["kafka_id"] for r in got} == {"c"} and got[0].name == "kafka.topic.schema.count"


def test_partition_counts(spark):
    df = spark.createDataFrame([("t", 0), ("t", 1), ("u", 0)], "topic STRING, partition INT")
    got = N.normalize(FE.partition_counts(df, at())).collect()
    assert {r.name: r.value for r in got} == {"t": 2.0, "u": 1.0}


def test_pages(spark, tmp_path):
    point = lambda v, owner: {"timestamp": "2021-03-14T15:00:00Z", "value": v, "metric.principal_id": owner}
    pages = [
        {"data": []},
        {"data": [point(n * n, f"mill-{n}") for n in (3, 4)], "meta": {"pagination": {"next_page_token": "more"}}},
        {"data": [point(0.5, "mill-9")]},
    ]
    for i, page in enumerate(pages):
        (tmp_path / f"page-{i}.json").write_text(json.dumps(page, indent=1))
    read = lambda by: read_pages(spark, str(tmp_path), "io.vendor.server/sent_bytes", by, "lkc-1")
    got = {r.tags["principal"]: r for r in FE.flatten_pages(read("metric.principal_id")).collect()}
    assert {k: r.fields["value"] for k, r in got.items()} == {"mill-3": "9", "mill-4": "16", "mill-9": "0.5"}
    assert got["mill-4"].name == "vendor_server_sent_bytes" and got["mill-4"].timestamp == datetime(2021, 3, 14, 15)
    assert got["mill-9"].tags["cluster_id"] == "lkc-1"
    assert FE.flatten_pages(read("metric.other")).count() == 0


def test_tags_and_keys(spark):
    df = raw(
        spark,
        [
            (AT, "a", {}, {"topic": "t", "env": "old", "x": "1"}),
            (AT, "a", {}, {"principal": "p"}),
            (AT, "b", {}, {"topic": "t", "principal": "p"}),
            (AT, "b", {}, {}),
        ],
    )
    ok, rejected = N.validate_metric_tags(df)
    assert ok.count() == 2 and rejected.count() == 2
    kept = FE.select_series(df, ["a"], ["topic", "env"], {"env": "new"}).collect()
    assert {tuple(sorted(r.tags.items())) for r in kept} == {(("env", "new"),), (("env", "new"), ("topic", "t"))}
    keys = [r[0] for r in df.select(FE.metric_key(F.col("name"), F.col("tags"))).collect()]
    assert keys == ["a:t", "a:p", "b:t", "b"]
    assert {r.name: r.sent for r in FE.metric_counts(df).collect()} == {"a": 2, "b": 2}
