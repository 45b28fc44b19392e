"""Streams over several runs: labels remembered, gauges that expire, a new start."""

import json

from helpers import prices, rules, ts

from tallyspark import MeteringConfig
from tallyspark.operators import gauges as G
from tallyspark.operators.labels import compile_rules
from tallyspark.plans import mapping as M
from tallyspark.plans.metering import usage_facts
from tallyspark.plans.queries import _arrivals
from tallyspark.sources.facts import FactTable
from tallyspark.sources.raw import read_raw
from tallyspark.streaming import gauges as SG
from tallyspark.streaming import metering as ST

OLD = "2023-01-01T00:00:00"
RULES = [("a", OLD, None, None, "TOPIC", "t.*", {"unit": "one"}), ("b", OLD, None, None, "TOPIC", "t1", {"zone": "z"})]
NOW = {"availableNow": True}


def write(folder, name, samples):
    """samples: (minute, topic, value)"""
    folder.mkdir(exist_ok=True)
    lines = [
        json.dumps({"timestamp": 1704067200 + 60 * m, "name": "m", "fields": {"gauge": v}, "tags": {"topic": t}})
        for m, t, v in samples
    ]
    (folder / name).write_text("\n".join(lines) + "\n")


def gauges_of(df):
    return {(json.dumps(json.loads(r.tags_json), sort_keys=True)): r.value for r in df.collect()}


def test_gauges_widen_update_and_expire_as_the_batch_says(spark, tmp_path):
    config, source, base = MeteringConfig(), tmp_path / "raw", str(tmp_path / "run")
    load = (lambda s: rules(s, RULES), lambda s: prices(s, []))

    def step():
        ST.run_available(read_raw(spark, str(source), streaming=True), base, config, *load)
        SG.start_gauges(spark, base, config, NOW).awaitTermination()
        got = gauges_of(SG.live_gauges(spark, base))
        samples = G.gauge_samples(FactTable(spark, f"{base}/facts").read())
        assert got == gauges_of(G.active_gauges(G.gauge_snapshot(samples), config))
        return got

    one = lambda t, zone="": json.dumps({"topic": t, "unit": "one", "zone": zone}, sort_keys=True)
    write(source, "a", [(0, "t0", 1.0), (5, "t1", 2.0)])
    assert step() == {one("t0"): 1.0, one("t1", "z"): 2.0}
    write(source, "b", [(30, "t0", 10.0)])  # the window is still open: its sum grows
    assert step() == {one("t0"): 11.0, one("t1", "z"): 2.0}
    write(source, "c", [(60, "t0", 5.0)])  # one window later: not yet gone
    assert step() == {one("t0"): 5.0, one("t1", "z"): 2.0}
    write(source, "d", [(121, "t0", 6.0)])  # t1 is gone, its tag key stays
    assert step() == {one("t0"): 6.0}
    write(source, "e", [(125, "t1", 7.0)])  # and back
    assert step() == {one("t0"): 6.0, one("t1", "z"): 7.0}
    assert step() == {one("t0"): 6.0, one("t1", "z"): 7.0}


def test_gauges_of_many_series_share_the_keys_of_the_state(spark, tmp_path):
    config, source, base = MeteringConfig(), tmp_path / "raw", str(tmp_path / "run")
    load = (lambda s: rules(s, RULES), lambda s: prices(s, []))
    number = SG.SLOTS + 500

    def step():
        ST.run_available(read_raw(spark, str(source), streaming=True), base, config, *load)
        stream = SG.start_gauges(spark, base, config, NOW)
        stream.awaitTermination()
        keys = [json.loads(p.json)["stateOperators"][0]["numRowsTotal"] for p in stream.recentProgress]
        got = SG.live_gauges(spark, base)
        samples = G.gauge_samples(FactTable(spark, f"{base}/facts").read())
        assert gauges_of(got) == gauges_of(G.active_gauges(G.gauge_snapshot(samples), config))
        return max(keys), {r.tags["topic"]: r.value for r in got.collect()}

    write(source, "a", [(0, f"t{i}", float(i)) for i in range(number)])
    keys, got = step()
    assert got == {f"t{i}": float(i) for i in range(number)}
    assert keys <= SG.SLOTS
    write(source, "b", [(60, f"t{i}", 2.0) for i in range(0, number, 2)])
    assert len(step()[1]) == number
    write(source, "c", [(121, "t2", 3.0)])  # the odd ones are gone, each out of a slot with others
    got = step()[1]
    assert got == {f"t{i}": 3.0 if i == 2 else 2.0 for i in range(0, number, 2)}


def test_entities_are_matched_once_for_each_state_of_the_rules(spark, tmp_path):
    config, out = MeteringConfig(), str(tmp_path / "labelled")
    state = [RULES]

    def batch(number, topics):
        folder = tmp_path / f"raw{number}"
        write(folder, "a", [(0, t, 1.0) for t in topics])
        ST.label_batch(read_raw(spark, str(folder)), number, out, config, lambda s: rules(s, state[0]), remember=True, max_inline=0)
        rows = spark.read.parquet(f"{out}/batch_id={number}").collect()
        return {r.name: json.loads(r.context_json) for r in rows}

    def matched(number):
        path = f"{out}/_labels/{ST.rule_epoch(rules(spark, state[0]))}/batch_id={number}"
        return sorted({r.name for r in spark.read.parquet(path).collect()})

    assert batch(0, ["t0", "t1", "x"]) == {"t0": {"unit": "one"}, "t1": {"unit": "one", "zone": "z"}, "x": {}}
    assert matched(0) == ["t0", "t1", "x"]
    assert batch(1, ["t1", "t2", "x"]) == {"t1": {"unit": "one", "zone": "z"}, "t2": {"unit": "one"}, "x": {}}
    assert matched(1) == ["t2"]
    state[0] = [*RULES, ("c", "2023-02-01T00:00:00", None, None, "TOPIC", "t1", {"zone": "new"})]
    assert batch(2, ["t1"]) == {"t1": {"unit": "one", "zone": "new"}}
    assert matched(2) == ["t1"]


def test_the_digest_of_rules_sees_each_change_and_no_order(spark):
    digest = lambda rows: ST.rule_epoch(rules(spark, rows))
    moved = [(*RULES[0][:2], ts_text, None, *RULES[0][4:]) for ts_text in (OLD,)]
    other = [(*RULES[0][:2], None, OLD, *RULES[0][4:])]
    assert digest(RULES) == digest(RULES[::-1]) == digest(RULES)
    assert len({digest(x) for x in (RULES, RULES[:1], moved, other, [*RULES, RULES[0]], [])}) == 6


def test_a_new_start_replaces_facts_from_a_window_on_and_goes_on(spark, tmp_path):
    config, source, base = MeteringConfig(), tmp_path / "raw", str(tmp_path / "run")
    load_rules = lambda s: rules(s, RULES)
    dear = lambda s: prices(s, [("m", 0.0, 2.0)])
    right = lambda s: prices(s, [("m", 0.0, 1.0)])

    def step(load_prices):
        ST.run_current(read_raw(spark, str(source), streaming=True), base, config, load_rules, load_prices)
        return {(r.start_time.hour, r.name): (r.value, r.cost) for r in FactTable(spark, f"{base}/facts").read().collect()}

    assert ST.current_run(spark, base) == (0, None, 1)
    write(source, "a", [(10, "t0", 1.0), (70, "t0", 2.0), (90, "t0", 3.0)])
    assert step(dear) == {(0, "t0"): (1.0, 2.0), (1, "t0"): (5.0, 10.0)}
    versions = FactTable(spark, f"{base}/facts").newest_version()
    # minute 80 is inside the second window, which is computed anew as a whole
    assert ST.reprocess_from(spark, base, config, ts("2024-01-01T01:20:00")) == 1
    assert ST.current_run(spark, base)[2] == versions + 1
    assert step(right) == {(0, "t0"): (1.0, 2.0), (1, "t0"): (5.0, 5.0)}
    write(source, "b", [(95, "t0", 4.0), (130, "t1", 1.0)])
    third = {(1, "t0"): (9.0, 9.0), (2, "t1"): (1.0, 1.0)}
    assert step(right) == {(0, "t0"): (1.0, 2.0), **third}
    # from the beginning
    assert ST.reprocess_from(spark, base, config) == 2
    assert step(right) == {(0, "t0"): (1.0, 1.0), **third}
    batch = usage_facts(read_raw(spark, str(source)), compile_rules(load_rules(spark)), right(spark), config)
    assert sorted(r.row_id for r in batch.collect()) == sorted(r.row_id for r in FactTable(spark, f"{base}/facts").read().collect())


def test_a_stream_of_one_file_is_labelled_by_all_cores(spark, tmp_path):
    base, cores = str(tmp_path / "run"), spark.sparkContext.defaultParallelism
    raw = next(_arrivals(spark, "/root/testdata/sf0.001", "2024-01-20 00:00:00"))
    ST.start_labelling(raw, base, M.EVENT_CONFIG, M.event_rules, NOW).awaitTermination()
    files = list((tmp_path / "run" / "labelled" / "batch_id=0").glob("*.parquet"))
    rows = [spark.read.parquet(str(f)).count() for f in files]
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert sum(rows) == events.filter("ts < '2024-01-20'").count()
    assert len(rows) == cores > 1 and max(rows) < 2 * sum(rows) / cores
