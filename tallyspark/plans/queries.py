"""Every operator as a query over the driver's tables: name -> f(spark, sf_dir)."""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.config import DEFAULT_SPLIT_KEYS
from tallyspark.functions import normalize as N
from tallyspark.functions.maps import canonical_json
from tallyspark.operators import (
    access,
    allocation,
    discovery,
    feeders,
    gauges,
    history,
    labels,
    panels,
    pricing,
    split,
    windows,
)
from tallyspark.plans import mapping as M
from tallyspark.plans import metering
from tallyspark.schemas import RULES
from tallyspark.session import scratch_path, written
from tallyspark.sources import facts as S
from tallyspark.sources import raw as R
from tallyspark.sources import rollups as RO
from tallyspark.sources import rules as RU
from tallyspark.streaming import gauges as SG
from tallyspark.streaming import metering as ST

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    """Register; results carry zone-less timestamps (UTC), as the tables do."""

    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fn(spark, sf_dir)
        stamps = [c for c, t in df.dtypes if t == "timestamp"]
        return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in stamps}) if stamps else df

    QUERIES[fn.__name__] = run
    return run


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def ctx(key: str) -> Column:
    return F.col("context")[key]


# -- sources, normalisation --------------------------------------------------------------


@query
def raw_parsed(spark, sf):
    """JSON records of the event table, some cut short, parsed back."""
    events = M.table(spark, sf, "events")
    body = F.to_json(
        F.struct(
            F.unix_seconds("ts").alias("timestamp"),
            F.concat(F.lit("svc_"), "event_type").alias("name"),
            F.struct(F.col("value").alias("gauge")).alias("fields"),
            F.struct(F.concat(F.lit("u"), "user_id").alias("topic")).alias("tags"),
        )
    )
    cut = F.when(F.col("event_id") % 10 == 7, F.substring(body, F.lit(1), F.length(body) - 3))
    records = events.select(F.coalesce(cut, body).alias("value"))
    parsed = R.valid_raw(R.parse_raw(records))
    return parsed.select(
        "timestamp", "name", N.metric_value(F.col("fields")).alias("value"), F.col("tags")["topic"].alias("topic")
    )


@query
def corrupt_records(spark, sf):
    """How many records per event type do not parse."""
    events = M.table(spark, sf, "events")
    head = F.concat(F.lit('{"timestamp":"'), F.unix_seconds("ts"), F.lit('","name":"x","fields":{},"tags":{}'))
    whole = F.when(F.col("event_id") % 3 == 0, F.concat(head, F.lit("}"))).otherwise(head)
    kinds = whole.alias("value"), F.concat(F.lit("events/"), "event_type").alias("source")
    parsed = R.parse_raw(events.select(*kinds), source="source")
    return R.corrupt_raw(parsed).groupBy("source").agg(F.count("*").alias("n"))


@query
def raw_balance(spark, sf):
    """Valid and corrupt records are all records: epoch and offset times, garbage and none at all."""
    events = M.table(spark, sf, "events")
    kind = F.col("event_id") % 5
    at = (
        F.when(kind == 0, F.unix_seconds("ts").cast("string"))
        .when(kind == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
        .when(kind == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(kind == 3, "soon")
    )
    fields = F.create_map(F.lit("gauge"), F.col("value").cast("string"))
    record = F.to_json(F.struct(at.alias("timestamp"), F.lit("m").alias("name"), fields.alias("fields")))
    parsed = R.parse_raw(events.select(record.alias("value"), F.col("event_type")), source="event_type")
    sides = R.valid_raw(parsed).withColumn("side", F.lit("valid")).unionByName(
        R.corrupt_raw(parsed).withColumn("side", F.lit("corrupt")), allowMissingColumns=True
    )
    return sides.groupBy("source", "side").agg(F.count("*").alias("n"), F.max("timestamp").alias("newest"))


@query
def normalized_metrics(spark, sf):
    raw = feeders.add_tags(M.raw_events(spark, sf), {"kafka_id": "lkc-1"})
    metrics = N.normalize(raw)
    return metrics.select("event_time", "entity_type", "name", "initial_metric_name", "value")


@query
def clean_names(spark, sf):
    part = M.table(spark, sf, "part")
    name = F.concat(F.lit("io.vendor."), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit(".ratio_b"))
    return part.select("p_partkey", N.normalize_metric_name(name).alias("metric_name"))


@query
def valid_tags(spark, sf):
    """Metrics with exactly one owner tag, and the rejected ones, per event type."""
    user = F.col("user_id")
    owner = F.concat(F.lit("o"), user)
    tags = (
        F.when(user % 4 == 0, F.create_map(F.lit("topic"), owner))
        .when(user % 4 == 1, F.create_map(F.lit("principal"), owner))
        .when(user % 4 == 2, F.create_map(F.lit("topic"), owner, F.lit("principal"), owner))
        .otherwise(F.create_map(F.lit("env"), F.lit("dev")))
    )
    metrics = M.table(spark, sf, "events").select("event_type", "value", tags.alias("tags"))
    ok, rejected = N.validate_metric_tags(metrics)
    both = ok.withColumn("verdict", F.lit("ok")).unionByName(rejected.withColumn("verdict", F.lit("rejected")))
    return both.groupBy("event_type", "verdict").agg(
        F.count("*").alias("n"), r6(F.sum("value")).alias("value")
    )


@query
def hour_floor(spark, sf):
    start, end = N.last_full_hour(F.col("ts"))
    return M.table(spark, sf, "events").select(
        "event_id", start.alias("hour_start"), end.alias("hour_end"), N.epoch_millis(end).alias("end_millis")
    )


@query
def parsed_instants(spark, sf):
    """ISO texts to instants and epoch numbers in both units; other formats are null."""
    event = F.col("event_id")
    text = F.when(event % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(
        F.date_format("ts", "yyyy/MM/dd HH:mm")
    )
    return M.table(spark, sf, "events").select(
        "event_id",
        N.parse_instant(text).alias("from_iso"),
        N.epoch_to_instant(F.unix_seconds("ts").cast("string"), "seconds").alias("from_seconds"),
        N.epoch_to_instant(F.unix_millis("ts").cast("string"), "millis").alias("from_millis"),
    )


@query
def price_per_gb(spark, sf):
    prices = labels.list_prices(M.price_changes(spark, sf))
    unit = F.when(F.col("base_cost") > 3, F.replace("metric_name", F.lit("_bytes"), F.lit("_count")))
    named = prices.withColumn("metric_name", F.coalesce(unit, F.col("metric_name")))
    return named.select(
        "metric_name", N.price_per_gb(F.col("metric_name"), F.col("cost_factor")).alias("per_gb")
    )


# -- changelogs --------------------------------------------------------------------------


@query
def latest_rules(spark, sf):
    rules = labels.list_rules(M.rule_changes(spark, sf))
    return rules.select("rule_id", "creation_time", "regex", ctx("priority").alias("priority"))


@query
def latest_prices(spark, sf):
    return labels.list_prices(M.price_changes(spark, sf)).select(
        "metric_name", "creation_time", "base_cost", "cost_factor"
    )


@query
def rule_changelog(spark, sf):
    """Saves and deletes appended to a changelog folder, then read as the current table."""
    log = RU.Changelog(spark, scratch_path(spark, "rules"))
    orders = M.rule_changes(spark, sf)
    saved = orders.filter(F.col("regex").isNotNull())
    log.append(RU.rule_saves(saved, F.col("version"), F.col("creation_time")))
    gone = orders.filter(F.col("regex").isNull())
    log.append(RU.rule_deletes(gone.select("rule_id", "version"), F.col("version")))
    return log.current().select("rule_id", "creation_time", ctx("priority").alias("priority"))


@query
def price_changelog(spark, sf):
    log = RU.Changelog(spark, scratch_path(spark, "prices"), "prices")
    orders = M.price_changes(spark, sf)
    saved = orders.filter(F.col("cost_factor").isNotNull())
    log.append(RU.price_saves(saved, F.col("version"), F.col("creation_time")))
    gone = orders.filter(F.col("cost_factor").isNull())
    log.append(RU.price_deletes(gone.select("metric_name", "version"), F.col("version")))
    return log.current().select("metric_name", "base_cost", "cost_factor")


@query
def rules_from_json(spark, sf):
    """Rules written as JSON lines, loaded again; the later of two equal keys wins."""
    path = scratch_path(spark, "rules-json")
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    M.table(spark, sf, "supplier").select(
        F.concat(F.lit("id-"), "s_suppkey").alias("id"),
        F.lit("TOPIC").alias("entityType"),
        F.concat(F.lit("supplier-"), "s_suppkey").alias("regex"),
        F.array(
            entry("name", F.lit("draft")),
            entry("nation", F.col("s_nationkey").cast("string")),
            entry("name", F.col("s_name")),
        ).alias("context"),
    ).write.json(path)
    rules = RU.load_rules_json(spark, path, lines=True)
    return rules.select("rule_id", "entity_type", "regex", canonical_json(F.col("context")).alias("context_json"))


@query
def prices_from_json(spark, sf):
    path = scratch_path(spark, "prices-json")
    M.table(spark, sf, "part").select(
        F.concat(F.lit("part_"), "p_partkey", F.lit("_bytes")).alias("metricName"),
        (F.col("p_size") * 1.0).alias("baseCost"),
        (F.col("p_retailprice") / 1000).alias("costFactor"),
        F.lit("storage").alias("type"),
    ).write.json(path)
    return RU.load_prices_json(spark, path, lines=True)


# -- labelling ---------------------------------------------------------------------------


@query
def labelled_metrics(spark, sf):
    labelled = labels.label(
        N.normalize(M.raw_events(spark, sf)), M.compiled_event_rules(spark)
    )
    return labelled.select(
        "event_time", "entity_type", "name", "initial_metric_name", "value",
        canonical_json(F.col("context")).alias("context_json"),
    )


@query
def labelled_by_segments(spark, sf):
    """The same labels by the join strategy of large rule sets."""
    compiled = labels.compile_rules(M.event_rules(spark), max_inline=0)
    metrics = N.normalize(M.raw_events(spark, sf))
    labelled = labels.label(metrics, compiled)
    return labelled.groupBy("entity_type", canonical_json(F.col("context")).alias("context_json")).agg(
        F.count("*").alias("n"), r6(F.sum("value")).alias("value")
    )


@query
def context_ranges(spark, sf):
    """The validity ranges of the label of every topic and principal."""
    compiled = labels.compile_rules(M.event_rules(spark), max_inline=0)
    segments = labels.context_segments(N.normalize(M.raw_events(spark, sf)), compiled)
    return segments.select(
        "entity_type",
        "name",
        F.date_format("seg_from", "yyyy-MM-dd").alias("seg_from"),
        F.date_format("seg_until", "yyyy-MM-dd").alias("seg_until"),
        canonical_json(F.col("context")).alias("context_json"),
    )


@query
def labelled_at_scale(spark, sf):
    """One rule per topic: rules grow with the data and meet the names in an equi-join."""
    labelled = labels.label(
        N.normalize(M.raw_lineitem(spark, sf)), M.compiled_supplier_rules(spark, sf)
    )
    return labelled.groupBy(ctx("region").alias("region"), ctx("nation").alias("nation")).agg(
        F.count("*").alias("n"), r6(F.sum("value")).alias("value")
    )


def _many_rules(spark):
    """62 rules of seven ages; every fourth entry is null, and one rule has no id."""
    i = F.col("id")
    no_time = F.lit(None).cast("timestamp")
    value = F.when(i % 4 != 0, F.concat(F.lit("v"), i))
    return spark.range(62).select(
        F.when(i != 5, F.concat(F.lit("m"), F.lpad(i.cast("string"), 2, "0"))).alias("rule_id"),
        F.expr("timestamp'2023-01-01' + make_interval(0, 0, 0, cast(id % 7 as int))").alias("creation_time"),
        no_time.alias("valid_from"),
        no_time.alias("valid_until"),
        F.lit("TOPIC").alias("entity_type"),
        F.concat(F.lit(".*\\.app"), i % 5, F.lit("\\..*[^a-z]")).alias("regex"),
        F.create_map(F.concat(F.lit("k"), i % 3), value).alias("context"),
    )


@query
def labelled_equal_paths(spark, sf):
    """Many rules with null entries and ids: the inline and the joined path label alike."""
    metrics = N.normalize(M.raw_events(spark, sf)).select("entity_type", "name", "timestamp").distinct()
    parts = []
    for path, most in (("inline", 63), ("joined", 0)):
        labelled = labels.label(metrics, labels.compile_rules(_many_rules(spark), max_inline=most))
        parts.append(labelled.withColumn("path", F.lit(path)))
    return parts[0].unionByName(parts[1]).groupBy(
        "path", "entity_type", "name", canonical_json(F.col("context")).alias("context_json")
    ).agg(F.count("*").alias("n"))


def _bay_rules(spark):
    """500 rules without a plain head; each names two bays."""
    i = F.col("id")
    no_time = F.lit(None).cast("timestamp")
    return spark.range(500).select(
        F.concat(F.lit("bay-"), i).alias("rule_id"),
        F.lit("1992-01-01").cast("timestamp").alias("creation_time"),
        no_time.alias("valid_from"),
        no_time.alias("valid_until"),
        F.lit("TOPIC").alias("entity_type"),
        F.concat(F.lit(".*[.]BAY("), i, F.lit("[.]|"), i + 500, F.lit("[.]).*")).alias("regex"),
        F.create_map(F.lit("zone"), F.concat(F.lit("zone-"), i), F.lit("bay"), F.lit("b$1")).alias("context"),
    )


@query
def labelled_open_rules(spark, sf):
    """500 patterns that start with anything: names meet them through the texts they require."""
    line = M.table(spark, sf, "lineitem").select(
        F.lit("TOPIC").alias("entity_type"),
        F.concat(F.lit("dock.bay"), F.col("l_partkey") % 1000, F.lit("."), F.lower("l_returnflag")).alias("name"),
        F.col("l_shipdate").alias("timestamp"),
        F.col("l_quantity").alias("value"),
    )
    labelled = labels.label(line, labels.compile_rules(_bay_rules(spark)), names=line)
    return labelled.groupBy(ctx("zone").alias("zone"), ctx("bay").alias("bay")).agg(
        F.count("*").alias("n"), r6(F.sum("value")).alias("value")
    )


@query
def labelled_rule_history(spark, sf):
    """Every order is a version of one rule, valid for 30 days; three topics match all of them."""
    at = F.col("o_orderdate")
    versions = M.table(spark, sf, "orders").select(
        F.concat(F.lit("order-"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("rule_id"),
        at.alias("creation_time"),
        at.alias("valid_from"),
        (at + F.expr("INTERVAL 30 DAYS")).alias("valid_until"),
        F.lit("TOPIC").alias("entity_type"),
        F.lit("ledger-.*").alias("regex"),
        F.create_map(F.lit("priority"), F.col("o_orderpriority")).alias("context"),
    )
    line = M.table(spark, sf, "lineitem").select(
        F.lit("TOPIC").alias("entity_type"),
        F.concat(F.lit("ledger-"), "l_returnflag").alias("name"),
        F.col("l_shipdate").alias("timestamp"),
        F.col("l_quantity").alias("value"),
    )
    labelled = labels.label(line, labels.compile_rules(versions, max_inline=0))
    return labelled.groupBy("name", F.coalesce(ctx("priority"), F.lit("none")).alias("priority")).agg(
        F.count("*").alias("n"), r6(F.sum("value")).alias("value")
    )


@query
def odd_templates(spark, sf):
    """Patterns that hide brackets in quotes or nested classes, on both paths: a template that
    names a group the pattern lacks stays text."""
    rows = [
        ("q", r"\Qsa-\E([0-9]+)", "quoted", "<$1>"),
        ("h", r"\Qsa-(\E.*|sa-.*", "hidden", "<$1>"),
        ("n", "[s[a]]+-(.*)", "nested", "$1;$2"),
        ("c", "[(?<x>]*sa-.*", "class", "${x}"),
    ]
    made = [(i, datetime(2023, 1, 1), None, None, "PRINCIPAL", rx, {k: t}) for i, rx, k, t in rows]
    rules = spark.createDataFrame(made, RULES)
    metrics = N.normalize(M.raw_events(spark, sf)).filter("entity_type = 'PRINCIPAL'")
    names = metrics.select("entity_type", "name", "timestamp").distinct()
    parts = [
        labels.label(names, labels.compile_rules(rules, max_inline=most)).withColumn("path", F.lit(path))
        for path, most in (("inline", 63), ("joined", 0))
    ]
    return parts[0].unionByName(parts[1]).groupBy(
        "path", "name", canonical_json(F.col("context")).alias("context_json")
    ).agg(F.count("*").alias("n"))


@query
def rejected_rules(spark, sf):
    """Rules whose pattern does not compile: every seventh supplier's has an open bracket."""
    rules = M.supplier_rules(spark, sf)
    broken = F.pmod(F.regexp_extract("rule_id", r"(\d+)", 1).cast("int"), F.lit(7)) == 0
    regex = F.when(broken, F.concat(F.lit("("), "regex")).otherwise(F.concat("regex", F.lit(".*")))
    compiled = labels.compile_rules(rules.withColumn("regex", regex))
    return compiled.rejected


@query
def template_missing_group(spark, sf):
    labelled = labels.label(
        N.normalize(M.raw_events(spark, sf)), M.compiled_event_rules(spark)
    )
    return (
        labelled.filter(ctx("zone").isNotNull())
        .groupBy("name", ctx("raw").alias("raw"), ctx("zone").alias("zone"))
        .agg(F.count("*").alias("n"))
    )


@query
def context_probe(spark, sf):
    """Every user id probed as a topic and as a principal at one instant."""
    strings = M.table(spark, sf, "events").select(
        F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("SA-"), "user_id"))
        .otherwise(F.concat(F.lit("stage1.app1.subject"), "user_id", F.lit(".v1")))
        .alias("text")
    ).distinct()
    at = F.lit("2024-01-20").cast("timestamp")
    probed = labels.probe_context(strings, M.compiled_event_rules(spark), at)
    return probed.select("name", "entity_type", canonical_json(F.col("context")).alias("context_json"))


# -- split -------------------------------------------------------------------------------


def _split(spark, sf, policy):
    config = dataclasses.replace(
        M.EVENT_CONFIG, split_keys=M.SPLIT_KEYS, missing_key={m: policy for m in M.SPLIT_KEYS}
    )
    compiled = M.compiled_event_rules(spark)
    labelled = labels.label(N.normalize(M.raw_events(spark, sf)), compiled)
    rows = split.split_among_principals(labelled, config, compiled)
    return rows.groupBy(
        "entity_type",
        "name",
        "initial_metric_name",
        canonical_json(F.col("context")).alias("context_json"),
    ).agg(F.count("*").alias("n"), r6(F.sum("value")).alias("value"))


@query
def split_fallback(spark, sf):
    return _split(spark, sf, "ASSIGN_TO_FALLBACK")


@query
def split_drop(spark, sf):
    return _split(spark, sf, "DROP")


@query
def split_pass(spark, sf):
    return _split(spark, sf, "PASS_THROUGH")


@query
def split_facts(spark, sf):
    """The whole run with splitting: windows of shares, priced."""
    config = dataclasses.replace(M.EVENT_CONFIG, split_keys=M.SPLIT_KEYS)
    facts = M.event_facts(spark, sf, config)
    return facts.select(
        "start_time", "entity_type", "name", "initial_metric_name", "context_json", "target",
        r6("value").alias("value"), r6("cost").alias("cost"),
    )


@query
def split_by_default_map(spark, sf):
    """The shipped map of split keys, over metrics of the names it has."""
    config = dataclasses.replace(M.EVENT_CONFIG, split_keys=DEFAULT_SPLIT_KEYS)
    out, into = (f"kafka_server_brokertopicmetrics_bytes{way}_total" for way in ("out", "in"))
    name = F.col("name")
    renamed = F.when(name == "svc_click_bytes", out).when(name == "svc_view_bytes", into).otherwise(name)
    raw = M.raw_events(spark, sf).withColumn("name", renamed)
    facts = metering.usage_facts(raw, M.compiled_event_rules(spark), M.event_prices(spark), config)
    return facts.groupBy("entity_type", "name", "initial_metric_name").agg(
        F.count("*").alias("n"), r6(F.sum("value")).alias("value")
    )


# -- windows and prices ------------------------------------------------------------------


@query
def hourly_sum_max(spark, sf):
    windowed = metering.windowed_usage(
        M.raw_events(spark, sf), M.compiled_event_rules(spark), M.EVENT_CONFIG
    )
    return windowed.select(
        "start_time", "end_time", "entity_type", "name", "initial_metric_name", "tags",
        "context_json", r6("value").alias("value"),
    )


@query
def hourly_cost_by_context(spark, sf):
    facts = M.event_facts(spark, sf)
    return facts.groupBy(
        "start_time",
        F.coalesce(ctx("app"), F.lit("unknown")).alias("app"),
        F.coalesce(ctx("cost-unit"), F.lit("unknown")).alias("cost_unit"),
    ).agg(r6(F.sum("value")).alias("value"), r6(F.sum("cost")).alias("cost"))


def _owned(spark, sf):
    raw = feeders.select_series(
        M.raw_events(spark, sf),
        ["svc_click_bytes", "svc_view_bytes", "svc_error_bytes"],
        ["topic", "env"],
        {"source": "metric-api"},
    )
    return raw.withColumn("value", N.metric_value(F.col("fields")))


def _all_series(spark, sf):
    return M.raw_events(spark, sf).withColumn("value", N.metric_value(F.col("fields")))


@query
def selected_series(spark, sf):
    return _owned(spark, sf).select(
        "event_time", "name", canonical_json(F.col("tags")).alias("tags_json"), "value"
    )


@query
def series_max(spark, sf):
    return windows.series_max(_all_series(spark, sf), "1 hour")


@query
def series_diff(spark, sf):
    rows = windows.series_diff(_all_series(spark, sf), "6 hours")
    return rows.withColumn("value", r6("value"))


@query
def priced_lines(spark, sf):
    facts = M.line_facts(spark, sf)
    return facts.select(
        "start_time", "end_time", "name", "initial_metric_name", "context_json",
        r6("value").alias("value"), r6("cost").alias("cost"),
    )


@query
def default_prices(spark, sf):
    """The sample price book applied to daily volumes under the vendor's metric names."""
    names = F.array(*[F.lit(m) for m, _, _ in pricing.DEFAULT_PRICE_BOOK])
    pick = (F.pmod(F.col("l_partkey"), F.lit(len(pricing.DEFAULT_PRICE_BOOK) + 1)) + 1).cast("int")
    usage = (
        M.table(spark, sf, "lineitem")
        .groupBy(F.coalesce(F.try_element_at(names, pick), F.lit("other")).alias("initial_metric_name"))
        .agg((F.sum("l_quantity") * 1e9).alias("value"))
    )
    priced = pricing.price(usage, pricing.default_price_book(spark))
    return priced.select("initial_metric_name", r6("value").alias("value"), r6("cost").alias("cost"))


@query
def windowed_records(spark, sf):
    """Keyed records of the result stream, read back from their JSON."""
    records = S.windowed_records(M.line_facts(spark, sf))
    key = F.from_json("key", "startTime TIMESTAMP, name STRING, initialMetricName STRING")
    value = F.from_json("value", "value DOUBLE, cost DOUBLE, context MAP<STRING, STRING>")
    return records.select(key.alias("k"), value.alias("v")).select(
        F.col("k.startTime").alias("start_time"),
        "k.name",
        F.col("k.initialMetricName").alias("initial_metric_name"),
        r6("v.value").alias("value"),
        r6("v.cost").alias("cost"),
        F.col("v.context")["region"].alias("region"),
    )


# -- stored facts ------------------------------------------------------------------------


@query
def fact_ids(spark, sf):
    return M.event_facts(spark, sf).select("row_id", "target", r6("value").alias("value"))


@query
def table_friendly(spark, sf):
    rows = S.to_table_friendly(M.event_facts(spark, sf))
    return rows.withColumns({"value": r6("value"), "cost": r6("cost")})


def _versioned_rows(spark, sf):
    """Daily supplier volumes; every line item rewrites the row of its supplier and day."""
    line = M.table(spark, sf, "lineitem")
    windowed = line.select(
        F.col("l_shipdate").alias("start_time"),
        (F.col("l_shipdate") + F.expr("INTERVAL 1 DAY")).alias("end_time"),
        F.lit("TOPIC").alias("entity_type"),
        F.concat(F.lit("supplier-"), "l_suppkey").alias("name"),
        F.lit("line_bytes").alias("initial_metric_name"),
        F.col("l_quantity").alias("value"),
        F.lit("{}").alias("tags"),
        F.create_map(F.lit("flag"), F.col("l_returnflag")).alias("context"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity").alias("version"),
    )
    keyed = S.fact_id(
        S.with_target(windowed.withColumn("context_json", canonical_json(F.col("context"))))
    )
    return keyed


@query
def upsert_by_row_id(spark, sf):
    """Newest version per row id: rows with different contexts stay apart."""
    rows = _versioned_rows(spark, sf).select("start_time", "name", "context_json", "row_id", "value", "version")
    return S.latest_by_row_id(rows).drop("version")


@query
def upsert_by_window_key(spark, sf):
    """Newest version per window key: the context is not part of it."""
    rows = _versioned_rows(spark, sf).select(*S.WINDOW_KEY, "context_json", "value", "version")
    return S.latest_by_window_key(rows).select("start_time", "name", "context_json", "value")


def _line_facts_once(spark, sf):
    """The facts for several upserts: windows are worked out once and written, ids are made of what is read back."""
    return S.to_facts(written(M.line_facts(spark, sf).drop("row_id", "target"), "line-facts"))


@query
def stored_facts(spark, sf):
    """Two overlapping upserts, a compaction into a fresh folder and a third upsert; then the current rows."""
    store = S.FactTable(spark, scratch_path(spark, "facts"), chunk_days=56)
    facts = _line_facts_once(spark, sf)
    store.upsert(facts.withColumn("value", F.lit(-1.0)))
    early = F.col("start_time") < F.lit("2000-01-01").cast("timestamp")
    store.upsert(facts.filter(early))
    store = store.compacted(scratch_path(spark, "facts"))
    store.upsert(facts.filter(~early))
    return store.read().select("start_time", "name", "initial_metric_name", r6("value").alias("value"))


@query
def stored_facts_range(spark, sf):
    """A table with wide chunks, read over a range by a reader that wasn't told the width."""
    path = scratch_path(spark, "facts")
    store = S.FactTable(spark, path, chunk_days=56)
    store.upsert(M.line_facts(spark, sf))
    rows = S.FactTable(spark, path).read(datetime(1996, 1, 1), datetime(1997, 1, 1))
    return rows.groupBy("initial_metric_name").agg(
        F.count("*").alias("n"), F.min("start_time").alias("oldest"), r6(F.sum("value")).alias("value")
    )


@query
def stored_by_window_key(spark, sf):
    """The table keyed by window: of two versions that differ in context the later one stays."""
    path = scratch_path(spark, "windows")
    facts = _line_facts_once(spark, sf)
    store = S.FactTable(spark, path, key=S.WINDOW_KEY)
    other = F.create_map(F.lit("was"), F.lit("before"))
    store.upsert(S.to_facts(facts.withColumn("context", other).drop("context_json").withColumn("value", F.lit(0.0))))
    store.upsert(facts.filter("initial_metric_name = 'line_A_bytes'"))
    rows = S.FactTable(spark, path, key=S.WINDOW_KEY).read()
    return rows.groupBy("initial_metric_name", F.col("context_json").contains("before").alias("before")).agg(
        F.count("*").alias("n"), r6(F.sum("value")).alias("value")
    )


@query
def retention_kept(spark, sf):
    """What remains after the chunks that ended before a cut-off are dropped."""
    store = S.FactTable(spark, scratch_path(spark, "retention"), chunk_days=28)
    store.upsert(M.line_facts(spark, sf))
    kept = store.retained(datetime(1998, 6, 15), scratch_path(spark, "retention"))
    return kept.read().groupBy("initial_metric_name").agg(
        F.count("*").alias("n"), F.min("start_time").alias("oldest"), r6(F.sum("value")).alias("value")
    )


@query
def range_export(spark, sf):
    """CSV export of a range, read as text again."""
    path = scratch_path(spark, "export-csv")
    S.export_facts(M.event_facts(spark, sf), path, "csv", M.EVENTS_FROM, M.EVENTS_TO)
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    return rows.select(
        "initial_metric_name", "entity_type", F.coalesce("name", F.lit("")).alias("name"), "tags",
        "context", r6(F.col("value").cast("double")).alias("value"), "target", "id",
    )


def _roundtrip(spark, sf, fmt):
    path = scratch_path(spark, f"export-{fmt}")
    S.export_facts(M.event_facts(spark, sf), path, fmt, M.EVENTS_FROM, M.EVENTS_TO)
    rows = S.import_facts(spark, path)
    return rows.select(
        "start_time", "initial_metric_name", "entity_type", "name", "context_json", "target", "row_id",
        r6("value").alias("value"),
    )


@query
def import_roundtrip_json(spark, sf):
    return _roundtrip(spark, sf, "json")


@query
def import_roundtrip_csv(spark, sf):
    return _roundtrip(spark, sf, "csv")


@query
def import_roundtrip_parquet(spark, sf):
    return _roundtrip(spark, sf, "parquet")


@query
def reprocessed_facts(spark, sf):
    """Reprocessing from the middle of a window starts at its boundary."""
    facts = metering.reprocess(
        M.raw_events(spark, sf),
        M.compiled_event_rules(spark),
        M.event_prices(spark),
        M.EVENT_CONFIG,
        datetime(2024, 1, 10, 7, 42, 13),
    )
    return facts.select("start_time", "row_id", r6("value").alias("value"), r6("cost").alias("cost"))


@query
def metric_keys(spark, sf):
    raw = M.raw_events(spark, sf)
    tags = F.transform_keys("tags", lambda k, _: F.when(k == "principal_id", "principal").otherwise(k))
    keyed = raw.withColumn("tags", tags)
    return keyed.groupBy(feeders.metric_key(F.col("name"), F.col("tags")).alias("record_key")).agg(
        F.count("*").alias("n")
    )


@query
def aggregated_export(spark, sf):
    path = scratch_path(spark, "aggregated")
    names = ["line_A_bytes", "line_N_bytes", "line_R_bytes"]
    allocation.export_aggregated(
        M.line_facts(spark, sf), path, M.SHIP_FROM, M.SHIP_TO, "nation", names
    )
    rows = spark.read.option("header", True).csv(path)
    short = {"A": "line_A_bytes", "N": "line_N_bytes", "R": "line_R_bytes"}
    return rows.select(
        "nation",
        *[r6(F.col(f"`{m} [bytes]`").cast("double")).alias(f"{s}_bytes") for s, m in short.items()],
        *[F.col(f"`{m} [%]`").cast("double").alias(f"{s}_percent") for s, m in short.items()],
    )


# -- discovery ---------------------------------------------------------------------------


@query
def metric_names(spark, sf):
    return discovery.metric_names(M.event_facts(spark, sf), M.EVENT_CONFIG)


@query
def raw_metric_names(spark, sf):
    return discovery.raw_metric_names(M.raw_events(spark, sf), M.EVENT_CONFIG)


@query
def distinct_metrics(spark, sf):
    return discovery.distinct_metrics(M.line_facts(spark, sf))


@query
def context_keys(spark, sf):
    return discovery.context_keys(M.event_facts(spark, sf))


@query
def context_values(spark, sf):
    return discovery.context_values(M.event_facts(spark, sf), "app")


@query
def tag_keys(spark, sf):
    return discovery.tag_keys(M.raw_events(spark, sf))


@query
def tag_values(spark, sf):
    return discovery.tag_values(M.raw_events(spark, sf), "topic")


@query
def picked_context(spark, sf):
    picked = discovery.pick_context(M.event_facts(spark, sf), ["app", "cost-unit"])
    return picked.groupBy(canonical_json(F.col("context")).alias("context_json")).agg(
        F.count("*").alias("n")
    )


# -- history -----------------------------------------------------------------------------


@query
def history_raw(spark, sf):
    rows = history.history(
        M.event_facts(spark, sf), M.EVENTS_FROM, M.EVENTS_TO, ["svc_click_bytes", "svc_error_bytes"]
    )
    return rows.select("start_time", "end_time", "name", "initial_metric_name", "row_id", r6("value").alias("value"))


@query
def history_series(spark, sf):
    series = history.history_series(M.line_facts(spark, sf), M.SHIP_FROM, M.SHIP_TO, ["line_R_bytes"])
    day = lambda t: F.date_format(t, "yyyyMMdd")
    return series.select(
        "name",
        "chunk",
        F.array_join(F.transform("times", day), ",").alias("times"),
        F.array_join(F.transform("values", lambda v: v.cast("bigint").cast("string")), ",").alias("values"),
    )


@query
def history_series_chunks(spark, sf):
    """A day's points of one series are cut wherever the limit says, and no chunk is longer."""
    facts = M.line_facts(spark, sf).withColumn("start_time", F.date_trunc("month", "start_time")).withColumn("name", ctx("region"))
    rows = history.history_series(facts, M.SHIP_FROM, M.SHIP_TO, ["line_R_bytes"], max_points=50)
    total = F.aggregate("values", F.lit(0.0), lambda s, v: s + v)
    return rows.select("name", "chunk", F.size("times").alias("n"), F.array_min("times").alias("first"), F.array_max("times").alias("last"), r6(total).alias("value"))


@query
def history_grouped_auto(spark, sf):
    rows = history.history_grouped(
        M.event_facts(spark, sf), M.EVENTS_FROM, M.EVENTS_TO, [], "app"
    )
    return rows.withColumn("value", r6("value"))


@query
def history_grouped_hours(spark, sf):
    rows = history.history_grouped(
        M.event_facts(spark, sf), M.EVENTS_FROM, M.EVENTS_TO, ["svc_view_bytes"], "cost-unit", 7
    )
    return rows.withColumn("value", r6("value"))


@query
def history_grouped_single(spark, sf):
    rows = history.history_single_bucket(
        M.line_facts(spark, sf), M.SHIP_FROM, M.SHIP_TO, ["line_A_bytes"], "region"
    )
    return rows.withColumn("value", r6("value"))


@query
def history_two_keys(spark, sf):
    rows = history.history_grouped(
        M.line_facts(spark, sf), M.SHIP_FROM, M.SHIP_TO, [], "region", 24 * 365, ["nation"]
    )
    return rows.withColumn("value", r6("value"))


@query
def metric_totals(spark, sf):
    rows = history.metric_totals(M.event_facts(spark, sf), M.EVENTS_FROM, M.EVENTS_TO)
    return rows.withColumn("total", r6("total"))


# -- allocation --------------------------------------------------------------------------


def _shares(df):
    return df.withColumns({"total": r6("total"), "percentage": r6("percentage")})


@query
def share_table_1key(spark, sf):
    return _shares(
        allocation.share_table(M.event_facts(spark, sf), M.EVENTS_FROM, M.EVENTS_TO, ["app"])
    )


@query
def share_table_2keys(spark, sf):
    return _shares(
        allocation.share_table(M.line_facts(spark, sf), M.SHIP_FROM, None, ["region", "nation"])
    )


@query
def share_csv(spark, sf):
    path = scratch_path(spark, "shares")
    table = allocation.share_table(M.event_facts(spark, sf), None, None, ["stage", "cost-unit"])
    allocation.write_share_csv(_shares(table), ["stage", "cost-unit"], path)
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    return rows.select(
        F.col("Metric").alias("metric"),
        "stage",
        F.col("cost-unit").alias("cost_unit"),
        F.col("Total").cast("double").alias("total"),
        F.col("Percentage").cast("double").alias("percentage"),
    )


def _bills(spark, sf):
    wide = M.monthly_bills(spark, sf)
    return wide, allocation.default_bills(wide, M.LINE_BILL_METRICS)


@query
def bill_lines(spark, sf):
    return _bills(spark, sf)[1]


@query
def bill_allocation(spark, sf):
    _, bills = _bills(spark, sf)
    rows = allocation.allocate_bill(M.line_facts(spark, sf), bills, ["nation", "region"])
    return rows.withColumn("price", F.round("price", 3))


@query
def bill_all_keys(spark, sf):
    """No keys named: the bills by every key that the facts have."""
    _, bills = _bills(spark, sf)
    rows = allocation.allocate_bill(M.line_facts(spark, sf), bills)
    return rows.withColumn("price", F.round("price", 3))


@query
def bill_edges(spark, sf):
    wide, bills = _bills(spark, sf)
    rows = allocation.allocate_bill(M.line_facts(spark, sf), bills, ["nation"])
    edges = allocation.allocation_edges(rows, wide, M.LINE_BILL_METRICS)
    return edges.withColumn("value", F.round("value", 3))


@query
def bill_check(spark, sf):
    wide = allocation.bill_mismatch(allocation.bill_residual(M.monthly_bills(spark, sf)))
    return wide.select("bill_id", "total", "other", "mismatch")


# -- panels and gauges -------------------------------------------------------------------


def _daily(spark, sf):
    return history.history_grouped(
        M.event_facts(spark, sf), M.EVENTS_FROM, M.EVENTS_TO, [], "cost-unit", 24
    )


@query
def series_matrix(spark, sf):
    rows = panels.series_matrix(_daily(spark, sf), ["alpha", "beta", "unknown"])
    return rows.withColumns({c: r6(c) for c in ("alpha", "beta", "unknown")})


@query
def series_normalized(spark, sf):
    rows = panels.normalize_series(_daily(spark, sf))
    return rows.withColumn("percent", r6("percent"))


@query
def series_csv(spark, sf):
    rows = history.history_grouped(
        M.line_facts(spark, sf), M.SHIP_FROM, M.SHIP_TO, [], "region", 24 * 30
    )
    return panels.series_csv(rows.withColumn("value", F.round("value", 1)))


@query
def series_totals(spark, sf):
    rows = panels.series_totals(_daily(spark, sf))
    return rows.withColumn("total", r6("total"))


def _snapshot(spark, sf):
    return gauges.gauge_snapshot(gauges.gauge_samples(M.event_facts(spark, sf), "usage_"))


@query
def gauge_snapshot(spark, sf):
    return _snapshot(spark, sf).select("name", "tags_json", r6("value").alias("value"), "last_seen")


@query
def active_gauges(spark, sf):
    config = dataclasses.replace(M.EVENT_CONFIG, window="1 day")
    return gauges.active_gauges(_snapshot(spark, sf), config).select(
        "name", "tags_json", r6("value").alias("value")
    )


def _split_gauges(spark, sf):
    config = dataclasses.replace(M.EVENT_CONFIG, split_keys=M.SPLIT_KEYS)
    return gauges.gauge_samples(M.event_facts(spark, sf, config), "usage_")


@query
def panel_sum_by_principal(spark, sf):
    rows = panels.panel_by(
        _split_gauges(spark, sf), "usage_svc_click_bytes", "principal", "sum",
        where=panels.known_principal(),
    )
    return rows.withColumn("value", r6("value"))


@query
def panel_max_by_topic(spark, sf):
    rows = panels.panel_by(
        _split_gauges(spark, sf), "usage_svc_view_bytes", "topic", "max",
        at=datetime(2024, 1, 20, 12), lookback="5 days", where=panels.known_principal(),
    )
    return rows.withColumn("value", r6("value"))


@query
def panel_share(spark, sf):
    rows = panels.panel_share(_split_gauges(spark, sf), "usage_svc_click_bytes", "sa-1")
    return rows.withColumn("share", r6("share"))


@query
def label_values(spark, sf):
    return panels.label_values(_split_gauges(spark, sf), "principal")


@query
def stream_equals_batch(spark, sf):
    """The event table as one available-now stream: labelled, windowed, priced, upserted."""
    base = scratch_path(spark, "stream")
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    source = (
        spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    )
    M.prepare(spark)
    ST.run_available(
        M.to_raw_events(R.spread(source)),
        base,
        M.EVENT_CONFIG,
        load_rules=lambda s: M.event_rules(s),
        load_prices=lambda s: M.event_prices(s),
    )
    facts = S.FactTable(spark, f"{base}/facts").read()
    return facts.select(
        "start_time", "entity_type", "name", "initial_metric_name", "context_json",
        r6("value").alias("value"), r6("cost").alias("cost"),
    )


@query
def stream_in_steps(spark, sf):
    """Two runs of the stream: a window that both fill is updated, rows that come too late are
    dropped; the newest rows of each sink, counted."""
    base, source = scratch_path(spark, "stream"), scratch_path(spark, "arrivals")
    events = spark.read.parquet(f"{sf}/events.parquet")
    cut, early = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-15 00:30:00", "2024-01-03 00:00:00"))
    late = events.filter(F.col("ts") < early).withColumn("value", F.col("value") + 1000)
    M.prepare(spark)
    for rows in (events.filter(F.col("ts") < cut), events.filter(F.col("ts") >= cut).unionByName(late)):
        rows.write.mode("append").parquet(source)
        ST.run_available(
            M.to_raw_events(R.spread(spark.readStream.schema(events.schema).parquet(source))),
            base,
            M.EVENT_CONFIG,
            load_rules=lambda s: M.event_rules(s),
            load_prices=lambda s: M.event_prices(s),
            sinks=True,
        )
    facts = S.FactTable(spark, f"{base}/facts").read()
    key = ["start_time", "entity_type", "name", "metric", "context"]
    friendly = spark.read.parquet(f"{base}/table_friendly").withColumnRenamed("initial_metric_name", "metric")
    text = lambda c: F.get_json_object("value", f"$.{c}")
    windowed = spark.read.parquet(f"{base}/windowed").select(
        "batch_id", text("startTime").alias("start_time"), text("entityType").alias("entity_type"), text("name").alias("name"),
        text("initialMetricName").alias("metric"), text("context").alias("context"), text("value").cast("double").alias("value"),
    )
    newest = lambda df: df.groupBy(*key).agg(F.max_by("value", "batch_id").alias("value"))
    sinks = {"facts": facts.withColumnRenamed("initial_metric_name", "metric"), "table_friendly": newest(friendly), "windowed": newest(windowed)}
    counted = [
        df.groupBy("metric").agg(F.count("*").alias("n"), r6(F.sum("value")).alias("value")).withColumn("sink", F.lit(name))
        for name, df in sinks.items()
    ]
    return functools.reduce(DataFrame.unionByName, counted)


def _arrivals(spark, sf, *cuts):
    """Paths of the events between the given times, written one after the other, and their stream."""
    source = scratch_path(spark, "arrivals")
    events = M.prepare(spark).read.parquet(f"{sf}/events.parquet")
    at = [F.lit(c).cast("timestamp_ntz") for c in cuts]

    def steps():
        for low, high in zip([None, *at], [*at, None]):
            rows = events if low is None else events.filter(F.col("ts") >= low)
            (rows if high is None else rows.filter(F.col("ts") < high)).write.mode("append").parquet(source)
            yield M.to_raw_events(R.spread(spark.readStream.schema(events.schema).parquet(source)))

    return steps()


@query
def live_gauges(spark, sf):
    """Gauges that follow the stream over three runs: those not updated for a window and half a minute are gone."""
    base = scratch_path(spark, "stream")
    for raw in _arrivals(spark, sf, "2024-01-10 00:30:00", "2024-01-20 00:00:00"):
        ST.run_available(raw, base, M.EVENT_CONFIG, load_rules=M.event_rules, load_prices=M.event_prices)
        SG.start_gauges(spark, base, M.EVENT_CONFIG, {"availableNow": True}, "usage_").awaitTermination()
    return SG.live_gauges(spark, base).select("name", "tags_json", r6("value").alias("value"), "last_seen")


@query
def stream_remembered_labels(spark, sf):
    """Labels by joins over three batches, those of earlier batches remembered; a rule is new in the third."""
    base = scratch_path(spark, "stream")
    newer = """SELECT 'r10', TIMESTAMP'2023-12-10', NULL, NULL, 'TOPIC', '.*\\\\.app[0-2]\\\\..*', map('epoch', 'second')"""
    for i, raw in enumerate(_arrivals(spark, sf, "2024-01-10 00:00:00", "2024-01-20 00:00:00")):
        load = M.event_rules if i < 2 else lambda s: M.event_rules(s).union(s.sql(newer))
        ST.start_labelling(raw, base, M.EVENT_CONFIG, load, {"availableNow": True}, remember=True, max_inline=0).awaitTermination()
    key = lambda c: F.get_json_object("context_json", f"$['{c}']")
    keys = [key(c).alias(c.replace("-", "_")) for c in ("app", "team", "cost-unit", "zone", "epoch")]
    labelled = spark.read.schema(f"{ST.LABELLED}, batch_id INT").parquet(f"{base}/labelled")
    # a context is parsed once for its entity and not for each sample
    whole = labelled.groupBy("entity_type", "name", "context_json").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return whole.groupBy("entity_type", "name", *keys).agg(F.sum("n").alias("n"), r6(F.sum("value")).alias("value"))


@query
def stream_reprocessed(spark, sf):
    """A stream that starts anew from an instant with a corrected price and then goes on: facts from that window on have it."""
    base = scratch_path(spark, "stream")
    arrivals = _arrivals(spark, sf, "2024-01-20 00:00:00")
    run = lambda raw, prices: ST.run_current(raw, base, M.EVENT_CONFIG, M.event_rules, prices)
    corrected = lambda s: M.event_prices(s).withColumn("cost_factor", F.when(F.col("metric_name") == "svc_click_bytes", 0.07).otherwise(F.col("cost_factor")))
    raw = next(arrivals)
    run(raw, M.event_prices)
    ST.reprocess_from(spark, base, M.EVENT_CONFIG, datetime(2024, 1, 15, 10, 20))
    run(raw, corrected)
    for raw in arrivals:
        run(raw, corrected)
    return S.FactTable(spark, f"{base}/facts").read().select(
        "start_time", "entity_type", "name", "initial_metric_name", "context_json", r6("value").alias("value"), r6("cost").alias("cost")
    )


# -- feeders -----------------------------------------------------------------------------


def _access(spark, sf):
    return M.topics(spark, sf), M.users(spark, sf), M.acls(spark, sf)


@query
def topic_access(spark, sf):
    return access.topic_access(*_access(spark, sf))


@query
def access_long_prefix(spark, sf):
    """Topic names and prefix rules longer than a broker would take."""
    long = F.concat("p_brand", F.lit("."), F.repeat(F.lit("x"), F.lit(300)))
    topics = M.table(spark, sf, "part").select(
        F.concat(long, F.lit("."), "p_size").alias("topic")
    ).distinct()
    brand = F.concat(F.lit("Brand#"), F.col("s_suppkey") % 25 + 1)
    acls = M.table(spark, sf, "supplier").select(
        F.concat(F.lit("user-"), "s_suppkey").alias("user"),
        F.lit("ALLOW").alias("rule_type"),
        F.lit("topic").alias("resource_type"),
        F.concat(brand, F.lit("."), F.repeat(F.lit("x"), F.lit(280))).alias("resource_name"),
        F.lit("PREFIX").alias("pattern_type"),
        F.array(F.lit("READ")).alias("operations"),
        F.lit(None).cast("string").alias("operation"),
    )
    rows = access.topic_access(topics, M.users(spark, sf), acls)
    return rows.select("user", F.length("topic").alias("topic_length"), F.md5("topic").alias("topic_md5"), "can_read", "can_write")


@query
def recalculated_rules(spark, sf):
    """Rules anew from the access lists, where two of three current ones differ."""
    config = access.AccessConfig(
        annotation_prefix=M.ANNOTATION_PREFIX, regex_prefix="(eu-1[.])?", regex_suffix="([.]copy)?"
    )
    created = F.lit("2024-01-02").cast("timestamp")
    contexts = access.topic_context(*_access(spark, sf), config)
    current = access.generate_rules(contexts, created, config)
    size = ctx("size").cast("int")
    stale = current.filter(size % 3 != 2).withColumn(
        "regex", F.when(size % 3 == 0, F.concat("regex", F.lit("?"))).otherwise(F.col("regex"))
    )
    rows = access.recalculate(*_access(spark, sf), stale, created, config)
    return rows.select("rule_id", "regex")


@query
def recalculated_changes(spark, sf):
    """Rules of the topics that changed access rules, groups of users or annotations touch; no others are worked out."""
    config = access.AccessConfig(
        annotation_prefix=M.ANNOTATION_PREFIX, regex_prefix="(eu-1[.])?", regex_suffix="([.]copy)?"
    )
    created = F.lit("2024-01-02").cast("timestamp")
    topics, users, acls = _access(spark, sf)
    key = F.substring_index("user", "-", -1).cast("int")
    by_name = (key % 5).isin(0, 1, 4)  # not for all topics
    ungrouped = F.create_map().cast("map<string,string>")
    grown = lambda v: F.when(v.cast("int") % 17 == 0, (v.cast("int") + 1).cast("string")).otherwise(v)
    size = M.ANNOTATION_PREFIX + "size"
    old = (
        topics.withColumn("annotations", F.transform_values("annotations", lambda k, v: F.when(k == size, grown(v)).otherwise(v))),
        users.withColumn("annotations", F.when((key % 3 == 0) & by_name, ungrouped).otherwise(F.col("annotations"))),
        acls.filter(~((key % 4 == 1) & by_name)),
    )
    current = access.generate_rules(access.topic_context(*old, config), created, config)
    rows = access.recalculate_changes(topics, users, acls, old, current, created, config)
    return rows.select("rule_id", "regex", canonical_json(F.col("context")).alias("context_json"))


def _generated(spark, sf):
    config = access.AccessConfig(
        annotation_prefix=M.ANNOTATION_PREFIX, regex_prefix="(eu-1[.])?", regex_suffix="([.]copy)?"
    )
    contexts = access.topic_context(*_access(spark, sf), config)
    created = F.lit("2024-01-01").cast("timestamp")
    return access.generate_rules(contexts, created, config)


@query
def generated_rules(spark, sf):
    return _generated(spark, sf).select(
        "rule_id", "entity_type", "regex", canonical_json(F.col("context")).alias("context_json")
    )


@query
def changed_rules(spark, sf):
    """Some published rules are current, some outdated, some missing."""
    new = _generated(spark, sf)
    size = F.col("context")["size"].cast("int")
    published = new.filter(size % 3 != 0).withColumn(
        "regex", F.when(size % 3 == 1, F.col("regex")).otherwise(F.concat("regex", F.lit("_old")))
    )
    return access.changed_rules(new, published).select("rule_id", "regex")


@query
def schema_counts(spark, sf):
    at = F.lit("2024-01-01").cast("timestamp")
    raw = feeders.schema_counts(M.schema_subjects(spark, sf), at, {"kafka_id": "lkc-1"})
    return raw.select("event_time", "name", F.col("fields")["gauge"].cast("bigint").alias("schemas"),
                      canonical_json(F.col("tags")).alias("tags_json"))


@query
def partition_counts(spark, sf):
    at = F.lit("2024-01-01").cast("timestamp")
    raw = feeders.partition_counts(M.topic_partitions(spark, sf), at)
    metrics = N.normalize(raw)
    return metrics.select("name", "entity_type", "initial_metric_name", "value")


@query
def metric_counts(spark, sf):
    return feeders.metric_counts(M.raw_events(spark, sf))


@query
def flattened_pages(spark, sf):
    raw = feeders.flatten_pages(M.vendor_pages(spark, sf))
    ok, _ = N.validate_metric_tags(raw)
    metrics = N.normalize(ok, ["principal"])
    return metrics.groupBy("timestamp", "entity_type", "name", "initial_metric_name").agg(
        F.count("*").alias("n"), F.sum("value").alias("value")
    )


@query
def paged_files(spark, sf):
    """The same pages as saved files, one a page, read by query and put together again."""
    path = scratch_path(spark, "pages")
    pages = M.vendor_pages(spark, sf).select("body", "group_by")
    pages.write.partitionBy("group_by").option("maxRecordsPerFile", 1).text(path)
    read = [
        R.read_pages(spark, f"{path}/group_by={by}", "io.vendor.server/sent_bytes", by, "lkc-1")
        for by in ("metric.principal_id", "metric.topic", "metric.other", "metric.never")
    ]
    ok, _ = N.validate_metric_tags(feeders.flatten_pages(functools.reduce(DataFrame.unionByName, read)))
    return N.normalize(ok, ["principal"]).groupBy("timestamp", "entity_type", "name", "initial_metric_name").agg(
        F.count("*").alias("n"), F.sum("value").alias("value")
    )


# -- documented extensions ---------------------------------------------------------------


@query
def rollup_daily(spark, sf):
    rows = windows.rollup(M.event_facts(spark, sf), "day", M.EVENT_CONFIG, ["app"])
    return rows.withColumns({"value": r6("value"), "cost": r6("cost")})


@query
def rollup_monthly(spark, sf):
    rows = windows.rollup(M.line_facts(spark, sf), "month", M.LINE_CONFIG, ["region"])
    return rows.withColumns({"value": r6("value"), "cost": r6("cost")})


@query
def rollup_maintained(spark, sf):
    """Months kept up to date over three upserts; the later ones lower what maxima had been taken of."""
    store = S.FactTable(spark, scratch_path(spark, "facts"), chunk_days=56)
    table = RO.RollupTable(store, scratch_path(spark, "rollup"), "month", M.LINE_CONFIG, ["region"])
    facts = _line_facts_once(spark, sf)
    early = F.col("start_time") < F.lit("1996-02-10").cast("timestamp")
    doubled = {"value": F.col("value") * 2, "cost": F.col("cost") * 2}
    for rows in (facts.withColumns(doubled), facts.filter(early), facts.filter(~early)):
        store.upsert(rows)
        table.refresh()
    return table.read().withColumns({"value": r6("value"), "cost": r6("cost")})


@query
def unclassified_entities(spark, sf):
    return metering.unclassified_entities(M.event_facts(spark, sf))


@query
def backtest_prices(spark, sf):
    rows = pricing.backtest_prices(M.line_facts(spark, sf), M.line_price_history(spark, sf))
    return rows.groupBy("initial_metric_name", F.year("start_time").alias("year")).agg(
        F.count("*").alias("n"), r6(F.sum("cost")).alias("cost")
    )


@query
def base_charge(spark, sf):
    rows = pricing.base_charge(M.event_facts(spark, sf), 0.5)
    return rows.groupBy("principal").agg(
        F.count("*").alias("hours"), F.sum("cost").alias("cost")
    )


def _cluster_raw(spark, sf):
    line = M.table(spark, sf, "lineitem")
    name = F.element_at(
        F.array(
            F.lit("confluent_kafka_server_request_bytes"),
            F.lit("confluent_kafka_server_response_bytes"),
            F.lit("confluent_kafka_server_retained_bytes"),
            F.lit("confluent_kafka_server_consumer_lag_offsets"),
        ),
        (F.col("l_partkey") % 4 + 1).cast("int"),
    )
    tags = F.create_map(
        F.lit("kafka_id"), F.concat(F.lit("lkc-"), F.col("l_suppkey") % 3),
        F.lit("principal_id"), F.concat(F.lit("sa-"), "l_suppkey"),
        F.lit("topic"), F.concat(F.lit("t-"), "l_suppkey"),
        F.lit("type"), F.when(F.col("l_linenumber") % 2 == 0, "Produce").otherwise("Fetch"),
        F.lit("consumer_group_id"), F.concat(F.lit("g"), F.col("l_orderkey") % 4),
    )
    return line.select(name.alias("name"), tags.alias("tags"), F.col("l_quantity").alias("value"))


@query
def usage_by_cluster_principal(spark, sf):
    return feeders.usage_by_cluster_principal(_cluster_raw(spark, sf), F.col("value"))


@query
def usage_by_cluster_topic(spark, sf):
    return feeders.usage_by_cluster_topic(_cluster_raw(spark, sf), F.col("value"))


@query
def gap_filled(spark, sf):
    hist = history.history_grouped(
        M.event_facts(spark, sf), M.EVENTS_FROM, M.EVENTS_TO, [], "app", 1
    )
    rows = panels.fill_gaps(hist, "1 hour")
    return rows.withColumn("value", r6("value"))


@query
def weighted_share(spark, sf):
    rows = allocation.weighted_share(
        M.line_facts(spark, sf), "region", "line_A_bytes", "line_R_bytes"
    )
    return rows.withColumns({"weighted": r6("weighted"), "share": r6("share")})


@query
def unit_category_summary(spark, sf):
    metric = F.col("initial_metric_name")
    category = F.when(metric == "line_A_bytes", "storage").otherwise("transfer")
    rows = allocation.unit_category_summary(M.line_facts(spark, sf), "region", category, "year")
    return rows.withColumns({"value": r6("value"), "cost": r6("cost")})
