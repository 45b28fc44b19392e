import json

from helpers import prices, rules

from tallyspark import MeteringConfig
from tallyspark.plans.metering import usage_facts
from tallyspark.sources.facts import FactTable
from tallyspark.sources.raw import read_raw
from tallyspark.streaming import metering as ST

OLD = "2023-01-01T00:00:00"
RULES = [
    ("w", OLD, None, None, "TOPIC", "t0", {"writers": "alice,bob"}),
    ("p", OLD, None, None, "PRINCIPAL", "alice", {"team": "a"}),
]


def write(folder, name, minutes, value=1.0):
    folder.mkdir(exist_ok=True)
    lines = [
        json.dumps({"timestamp": 1704067200 + 60 * m, "name": "m", "fields": {"gauge": value}, "tags": {"topic": f"t{m % 2}"}})
        for m in minutes
    ]
    (folder / name).write_text("\n".join(lines) + "\n")


def rows(df):
    return sorted((r.start_time, r.entity_type, r.name, r.context_json, r.value, r.cost) for r in df.collect())


def test_stream_in_steps_equals_batch(spark, tmp_path):
    config = MeteringConfig(split_keys={"m": "writers"})
    source, base = tmp_path / "raw", str(tmp_path / "run")
    loaders = (lambda s: rules(s, RULES), lambda s: prices(s, [("m", 1.0, 2.0)]))

    def step():
        ST.run_available(read_raw(spark, str(source), streaming=True), base, config, *loaders)
        return rows(FactTable(spark, f"{base}/facts").read())

    def batch():
        return rows(usage_facts(read_raw(spark, str(source)), loaders[0](spark), loaders[1](spark), config))

    write(source, "a", range(0, 50, 5))
    assert step() == batch()
    # the open window grows, a new one starts: the stored row is replaced, not added
    write(source, "b", range(55, 90, 5))
    assert step() == batch()
    assert step() == batch()  # nothing new
    # a window that the watermark has passed stays as it is
    write(source, "late", [1, 2], 100.0)
    before = rows(FactTable(spark, f"{base}/facts").read())
    assert step() == before != batch()


def test_replayed_label_batch_is_skipped(spark, tmp_path):
    out, config = str(tmp_path / "labelled"), MeteringConfig()
    write(tmp_path / "raw", "a", [0])
    df = read_raw(spark, str(tmp_path / "raw"))
    ST.label_batch(df, 0, out, config, lambda s: rules(s, RULES))
    ST.label_batch(df.union(df), 0, out, config, lambda s: rules(s, RULES))
    assert spark.read.schema(ST.LABELLED).parquet(out).count() == 1
