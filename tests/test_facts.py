from datetime import datetime

import pytest
from helpers import facts, ts
from pyspark.sql import functions as F

from tallyspark.sources import facts as S
from tallyspark.sources import rules as RU

H = [f"2024-01-01T{h:02}:00:00" for h in range(24)]


def sample(spark, value=1.0, hours=(0, 1)):
    return facts(
        spark,
        [(H[h], H[h + 1], "m", value, {"app": "a", "topic": "t"}, "t", "TOPIC") for h in hours],
    )


def test_id_ignores_the_value_but_not_the_context(spark):
    a, b = sample(spark, 1.0).first(), sample(spark, 2.0).first()
    other = facts(spark, [(H[0], H[1], "m", 1, {"app": "b"}, "t", "TOPIC")]).first()
    assert a.row_id == b.row_id and a.row_id != other.row_id
    assert a.target == "t" and other.target == "unknown"


def test_upsert_is_idempotent(spark, tmp_path):
    store = S.FactTable(spark, str(tmp_path / "f"))
    assert store.read().count() == 0 and store.newest_version() == 0
    store.upsert(sample(spark))
    store.upsert(sample(spark))
    assert store.read().count() == 2
    store.upsert(sample(spark, 5.0, (1, 2)))
    want = {0: 1.0, 1: 5.0, 2: 5.0}
    current = lambda table: {r.start_time.hour: r.value for r in table.read().collect()}
    assert current(store) == want
    fresh = store.compacted(str(tmp_path / "g"))
    assert current(fresh) == want and fresh.versions().count() == 3
    fresh.upsert(sample(spark, 7.0, (0,)))
    assert current(fresh) == {**want, 0: 7.0} and current(store) == want
    assert current(fresh.compacted(str(tmp_path / "h"))) == {**want, 0: 7.0}
    got = fresh.read(ts(H[1]), ts(H[3])).collect()
    assert sorted(r.start_time.hour for r in got) == [1, 2]


def test_replayed_version_replaces_itself(spark, tmp_path):
    store = S.FactTable(spark, str(tmp_path / "f"))
    store.upsert(sample(spark, 1.0), version=3)
    store.upsert(sample(spark, 1.0), version=3)
    assert store.newest_version() == 3 and store.versions().count() == 2 and store.read().count() == 2


def test_a_null_in_the_key_is_a_value(spark, tmp_path):
    store = S.FactTable(spark, str(tmp_path / "f"), key=S.WINDOW_KEY)
    for value in (1.0, 2.0):
        store.upsert(sample(spark, value).withColumn("name", F.lit(None).cast("string")))
    assert [r.value for r in store.read().collect()] == [2.0, 2.0]


def days_of_january(spark, days):
    return facts(spark, [(f"2024-01-{d:02}T00:00:00", f"2024-01-{d:02}T01:00:00", "m", d, {}, "t", "TOPIC") for d in days])


def test_ranges_read_only_their_chunks(spark, tmp_path):
    store = S.FactTable(spark, str(tmp_path / "f"), chunk_days=1)
    store.upsert(days_of_january(spark, (1, 2, 3)))
    store.upsert(days_of_january(spark, (2, 3)).withColumn("value", F.lit(9.0)))
    assert sorted(r.value for r in store.read().collect()) == [1.0, 9.0, 9.0]
    plan = store.read(datetime(2024, 1, 2), datetime(2024, 1, 3))._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan parquet" in x]
    assert scans and all("PartitionFilters: [" in x and "chunk_start" in x.split("PartitionFilters")[1] for x in scans)


def test_readers_need_not_know_the_width_of_the_chunks(spark, tmp_path):
    path = str(tmp_path / "f")
    S.FactTable(spark, path, chunk_days=20).upsert(days_of_january(spark, range(1, 29)))
    assert S.FactTable(spark, path).read(datetime(2024, 1, 9), datetime(2024, 1, 20)).count() == 11
    S.FactTable(spark, path, chunk_days=3).upsert(days_of_january(spark, range(5, 12)).withColumn("value", F.lit(0.0)))
    rows = S.FactTable(spark, path).read(datetime(2024, 1, 9), datetime(2024, 1, 20)).collect()
    assert len(rows) == 11 and sum(r.value == 0 for r in rows) == 3


def test_retention_drops_whole_chunks(spark, tmp_path):
    store = S.FactTable(spark, str(tmp_path / "f"), chunk_days=1)
    store.upsert(days_of_january(spark, (1, 2, 3)))
    kept = store.retained(datetime(2024, 1, 2), str(tmp_path / "g"))
    assert sorted(r.value for r in kept.read().collect()) == [2.0, 3.0]
    assert store.read().count() == 3


def test_window_key_ignores_the_context(spark):
    rows = facts(
        spark,
        [(H[0], H[1], "m", 1, {"app": "a"}, "t", "TOPIC"), (H[0], H[1], "m", 2, {"app": "b"}, "t", "TOPIC")],
    ).withColumn("version", F.col("value").cast("int"))
    assert [r.value for r in S.latest_by_window_key(rows).collect()] == [2.0]
    assert S.latest_by_row_id(rows).count() == 2
    assert S.upsert_jdbc_rows(rows).first().context == '{"app":"b"}'


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_export_and_import(spark, tmp_path, fmt):
    rows = facts(
        spark,
        [
            (H[0], H[1], "m", 1.5, {"app": 'quo"te', "org": "x,y"}, "t", "TOPIC"),
            (H[0], H[1], "m", 2.5, {}, "", "UNKNOWN"),
            (H[5], H[6], "m", 3.5, {}, "late", "TOPIC"),
        ],
    )
    path = str(tmp_path / "out")
    S.export_facts(rows, path, fmt, ts(H[0]), ts(H[4]))
    back = {r.name: r for r in S.import_facts(spark, path).collect()}
    assert set(back) == {"t", ""}
    assert back["t"].context == {"app": 'quo"te', "org": "x,y"} and back["t"].value == 1.5
    assert back["t"].row_id == rows.filter("name = 't'").first().row_id
    with pytest.raises(ValueError):
        S.export_facts(rows, path, "xlsx")


def test_changelog(spark, tmp_path):
    log = RU.Changelog(spark, str(tmp_path / "log"))
    rule = spark.sql(
        "SELECT CAST(NULL AS STRING) rule_id, CAST(NULL AS TIMESTAMP) creation_time, CAST(NULL AS TIMESTAMP) "
        "valid_from, CAST(NULL AS TIMESTAMP) valid_until, 'TOPIC' entity_type, 't.*' regex, map('k','v') context"
    )
    log.append(RU.rule_saves(rule, F.lit(1)))
    named = rule.withColumn("rule_id", F.lit("mine"))
    log.append(RU.rule_saves(named, F.lit(2)))
    log.append(RU.rule_saves(named.withColumn("regex", F.lit("u.*")), F.lit(3)))
    current = {r.rule_id: r for r in log.current().collect()}
    assert len(current) == 2 and current["mine"].regex == "u.*" and current["mine"].creation_time
    log.append(RU.rule_deletes(spark.createDataFrame([("mine",)], "id STRING"), F.lit(4)))
    assert "mine" not in {r.rule_id for r in log.current().collect()}


def test_rule_and_price_files(spark, tmp_path):
    (tmp_path / "rules.json").write_text(
        '[\n {"id": "1", "entityType": "TOPIC", "regex": ".*x", "context": [\n  {"key": "a", "value": "1"},'
        '\n  {"key": "a", "value": "2"}]},\n {"id": "2", "entityType": "TOPIC", "regex": "y", "context": []}\n]'
    )
    (tmp_path / "prices.json").write_text('[{"metricName": "m", "baseCost": 0, "costFactor": 1e-10, "comment": "c"}]')
    got = {r.rule_id: r.context for r in RU.load_rules_json(spark, str(tmp_path / "rules.json")).collect()}
    assert got == {"1": {"a": "2"}, "2": {}}
    assert tuple(RU.load_prices_json(spark, str(tmp_path / "prices.json")).first()) == ("m", 0.0, 1e-10)


def test_only_chunks_with_several_versions_meet(spark, tmp_path):
    """A chunk with one version is read as it is; widths that differ make all rows meet."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    store = S.FactTable(spark, str(tmp_path / "f"))
    day = lambda d, value: facts(spark, [(f"2024-0{d}-01T00:00:00", f"2024-0{d}-01T01:00:00", "m", value, {}, "t", "TOPIC")])
    current = lambda table: {r.start_time.month: r.value for r in table.read().collect()}
    store.upsert(day(1, 1).union(day(2, 1)))
    assert "Join" not in plan(store.read()) and current(store) == {1: 1.0, 2: 1.0}
    store.upsert(day(2, 5).union(day(3, 5)))
    assert plan(store.read()).count("Join") == 1 and "Union" in plan(store.read())
    assert current(store) == {1: 1.0, 2: 5.0, 3: 5.0}
    assert "Join" not in plan(store.compacted(str(tmp_path / "g")).read())
    S.FactTable(spark, store.path, chunk_days=28).upsert(day(1, 9))
    assert current(store) == {1: 9.0, 2: 5.0, 3: 5.0}


def test_the_newest_version_of_a_chunk_does_not_meet_and_ids_of_any_kind_stay(spark, tmp_path):
    """No aggregate of all keys; ids that follow from the row are not stored, others are, a null one too."""
    store = S.FactTable(spark, str(tmp_path / "f"))
    rows = sample(spark, 1.0, (0, 1, 2, 3))
    other = F.when(F.hour("start_time") == 1, "0A").when(F.hour("start_time") == 2, F.lit(None)).otherwise(F.col("row_id"))
    rows = rows.withColumn("row_id", other)
    store.upsert(rows)
    store.upsert(rows.filter("hour(start_time) in (1, 2, 3)").withColumn("value", F.lit(2.0)))
    store.upsert(rows.filter("hour(start_time) = 3").withColumn("value", F.lit(3.0)))
    plan = store.read()._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Join") == 1
    current = lambda table: sorted((r.start_time.hour, r.row_id, r.value) for r in table.read().collect())
    want = [(r.start_time.hour, r.row_id, {0: 1.0, 3: 3.0}.get(r.start_time.hour, 2.0)) for r in rows.collect()]
    assert current(store) == sorted(want)
    assert current(store.compacted(str(tmp_path / "g"))) == sorted(want)
    stored = spark.read.parquet(f"{store.path}/version=1")
    assert sorted(stored.filter("row_id IS NOT NULL").select("row_id").collect()) == [("0A",)]
    older = store.versions().filter("version = 3").select(*rows.columns)  # a folder without the mark
    older.write.parquet(f"{store.path}/version=4/chunk_days=7/chunk_start=2023-12-28")
    assert len(current(store)) == 4


def test_the_newest_version_is_found_without_carrying_what_nobody_reads(spark):
    """The order travels once, ids as bytes; ids that are no digests, and null ones, are kept."""
    rows = spark.sql("SELECT IF(id % 4 = 0, NULL, IF(id % 4 = 1, 'AB', IF(id % 4 = 2, 'ab', 'x'))) row_id, struct(id AS a, -id AS b) version, id * 1.0D value FROM range(40)")
    got = S.latest_by_row_id(rows)
    assert got.columns == rows.columns
    assert sorted((r.row_id or "", r.version.a, r.version.b, r.value) for r in got.collect()) == [("", 36, -36, 36.0), ("AB", 37, -37, 37.0), ("ab", 38, -38, 38.0), ("x", 39, -39, 39.0)]
    plan = got.select("row_id", "value")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("max_by(") == 1 and "max(struct" not in plan
    assert plan.count("version, version#") == 1
