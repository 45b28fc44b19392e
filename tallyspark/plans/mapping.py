"""The driver's tables in this domain's shapes: raw metrics, rules, prices, bills, access lists.

``events`` are samples of five metrics, owned by a topic, a principal or nobody.
``lineitem`` are daily samples of three metrics, one topic per supplier, and the supplier
tables give one rule per topic. ``orders`` serve as changelogs and as bills, ``part`` and
``supplier`` as topics, users and access lists.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.config import MeteringConfig
from tallyspark.operators.labels import compile_rules
from tallyspark.plans.metering import usage_facts
from tallyspark.session import prepare

EVENTS_FROM, EVENTS_TO = datetime(2024, 1, 3), datetime(2024, 1, 27, 12)
SHIP_FROM, SHIP_TO = datetime(1996, 1, 1), datetime(2000, 1, 1)

EVENT_CONFIG = MeteringConfig(window="1 hour", aggregations={"svc_error_bytes": "max"})
LINE_CONFIG = MeteringConfig(window="1 day", aggregations={"line_N_bytes": "MAX"})
SPLIT_KEYS = {"svc_click_bytes": "readers", "svc_view_bytes": "writers"}
LINE_BILL_METRICS = {
    "storage": "line_A_bytes",
    "network_read": "line_R_bytes",
    "network_write": "line_N_bytes",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; its zone-less timestamps are instants in UTC."""
    prepare(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ntz = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


# -- events ------------------------------------------------------------------------------


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_raw_events(table(spark, sf_dir, "events"))


def to_raw_events(events: DataFrame) -> DataFrame:
    user, event = F.col("user_id"), F.col("event_id")
    value = F.col("value").cast("string")
    topic = F.concat(
        F.lit("stage"), user % 2, F.lit(".app"), user % 5, F.lit(".subject"), user, F.lit(".v1")
    )
    no_fields = F.create_map().cast("map<string,string>")
    fields = (
        F.when(event % 4 == 0, F.create_map(F.lit("gauge"), value))
        .when(event % 4 == 1, F.create_map(F.lit("counter"), value))
        .when(event % 4 == 2, F.create_map(F.lit("variance"), F.lit("1"), F.lit("mean"), value))
        .otherwise(no_fields)
    )
    extra = [F.lit("env"), F.lit("dev"), F.lit("k"), F.get_json_object("props", "$.k")]
    tags = (
        F.when(user % 3 == 0, F.create_map(F.lit("topic"), topic, *extra))
        .when(
            user % 3 == 1,
            F.create_map(F.lit("principal_id"), F.concat(F.lit("sa-"), user), *extra),
        )
        .otherwise(F.create_map(*extra))
    )
    at = F.col("ts").cast("timestamp")
    return events.select(
        at.alias("event_time"),
        at.alias("timestamp"),
        F.concat(F.lit("svc_"), "event_type", F.lit("_bytes")).alias("name"),
        fields.alias("fields"),
        tags.alias("tags"),
        "event_id",
    )


EVENT_RULES = r"""
SELECT * FROM VALUES
 ('r1', TIMESTAMP'2023-12-01', NULL, NULL, 'TOPIC', 'stage([01])\\.(app[0-9]+)\\..+',
  map('stage', 'tier $1', 'app', '$2')),
 ('r2', TIMESTAMP'2023-12-05', NULL, NULL, 'TOPIC', '.*\\.app1\\..*', map('app', 'billing')),
 ('r3', TIMESTAMP'2023-12-02', NULL, TIMESTAMP'2024-01-15', 'TOPIC', 'stage0\\..*', map('cost-unit', 'alpha')),
 ('r4', TIMESTAMP'2023-12-02', TIMESTAMP'2024-01-15', NULL, 'TOPIC', 'stage0\\..*', map('cost-unit', 'beta')),
 ('r5', TIMESTAMP'2023-12-03', NULL, NULL, 'PRINCIPAL', 'sa-(\\d+)', map('team', 'team-$1', 'app', 'svc')),
 ('r6', TIMESTAMP'2023-12-03', NULL, NULL, 'TOPIC', '.*\\.app2\\..*', map('readers', 'sa-1,,sa-4', 'writers', 'sa-7,sa-10,,')),
 ('r7', TIMESTAMP'2023-12-03', NULL, NULL, 'TOPIC', '.*\\.app3\\..*', map('readers', ',', 'writers', '')),
 ('r8', TIMESTAMP'2023-12-04', NULL, NULL, 'TOPIC', '(STAGE1)\\..*', map('raw', '$2', 'zone', 'z-$1')),
 ('r9', TIMESTAMP'2023-12-06', NULL, NULL, 'TOPIC', 'stage(0', map('broken', 'x'))
 AS t(rule_id, creation_time, valid_from, valid_until, entity_type, regex, context)
"""


def event_rules(spark: SparkSession) -> DataFrame:
    return prepare(spark).sql(EVENT_RULES)


def compiled_event_rules(spark: SparkSession):
    return compile_rules(event_rules(spark))


def event_prices(spark: SparkSession) -> DataFrame:
    return prepare(spark).sql(
        """SELECT * FROM VALUES ('svc_click_bytes', 0.1D, 0.05D), ('svc_view_bytes', 0.0D, 0.002D),
        ('svc_error_bytes', 1.5D, 0.0D), ('svc_purchase_bytes', 0.25D, 0.01D)
        AS t(metric_name, base_cost, cost_factor)"""
    )


def event_facts(spark: SparkSession, sf_dir: str, config: MeteringConfig = EVENT_CONFIG) -> DataFrame:
    return usage_facts(
        raw_events(spark, sf_dir), compiled_event_rules(spark), event_prices(spark), config
    )


# -- lineitem ----------------------------------------------------------------------------


def raw_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("l_shipdate")
    return table(spark, sf_dir, "lineitem").select(
        at.alias("event_time"),
        at.alias("timestamp"),
        F.concat(F.lit("line_"), "l_returnflag", F.lit("_bytes")).alias("name"),
        F.create_map(F.lit("gauge"), F.col("l_quantity").cast("string")).alias("fields"),
        F.create_map(F.lit("topic"), F.concat(F.lit("supplier-"), "l_suppkey")).alias("tags"),
    )


def supplier_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule per supplier topic, so the rules grow with the topics."""
    place = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    unbounded = F.lit(None).cast("timestamp")
    return (
        table(spark, sf_dir, "supplier")
        .join(place, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.concat(F.lit("rule-"), "s_suppkey").alias("rule_id"),
            F.lit("1995-01-01").cast("timestamp").alias("creation_time"),
            unbounded.alias("valid_from"),
            unbounded.alias("valid_until"),
            F.lit("TOPIC").alias("entity_type"),
            F.concat(F.lit("supplier-"), "s_suppkey").alias("regex"),
            F.create_map(
                F.lit("nation"), F.col("n_name"), F.lit("region"), F.col("r_name")
            ).alias("context"),
        )
    )


def line_prices(spark: SparkSession) -> DataFrame:
    return prepare(spark).sql(
        """SELECT * FROM VALUES ('line_A_bytes', 0.1D, 0.05D), ('line_N_bytes', 0.0D, 0.002D)
        AS t(metric_name, base_cost, cost_factor)"""
    )


def compiled_supplier_rules(spark: SparkSession, sf_dir: str):
    return compile_rules(supplier_rules(spark, sf_dir))


def line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_facts(
        raw_lineitem(spark, sf_dir),
        compiled_supplier_rules(spark, sf_dir),
        line_prices(spark),
        LINE_CONFIG,
    )


# -- orders: changelogs and bills --------------------------------------------------------


def rule_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order rewrites the rule of its customer; a filled order deletes it."""
    gone = F.col("o_orderstatus") == "F"
    unbounded = F.lit(None).cast("timestamp")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("customer-"), "o_custkey").alias("rule_id"),
        F.when(~gone, F.col("o_orderdate")).alias("creation_time"),
        unbounded.alias("valid_from"),
        unbounded.alias("valid_until"),
        F.when(~gone, "TOPIC").alias("entity_type"),
        F.when(~gone, F.concat(F.lit("customer-"), "o_custkey", F.lit("[.].*"))).alias("regex"),
        F.when(~gone, F.create_map(F.lit("priority"), F.col("o_orderpriority"))).alias("context"),
        F.col("o_orderkey").alias("version"),
    )


def price_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of one metric per customer over time; a filled order deletes the rule."""
    gone = F.col("o_orderstatus") == "F"
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("customer_"), "o_custkey", F.lit("_bytes")).alias("metric_name"),
        F.when(~gone, F.col("o_orderdate")).alias("creation_time"),
        F.when(~gone, (F.col("o_custkey") % 7).cast("double")).alias("base_cost"),
        F.when(~gone, F.col("o_totalprice") / 1e14).alias("cost_factor"),
        F.col("o_orderkey").alias("version"),
    )


def line_price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price per metric and year, derived from the orders of the year before."""
    flag = F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return (
        table(spark, sf_dir, "orders")
        .groupBy(
            F.concat(F.lit("line_"), flag, F.lit("_bytes")).alias("metric_name"),
            F.date_trunc("year", "o_orderdate").alias("_year"),
        )
        .agg(F.count("*").alias("n"))
        .select(
            "metric_name",
            (F.col("_year") + F.expr("INTERVAL 1 YEAR")).alias("creation_time"),
            F.lit(0.5).alias("base_cost"),
            (F.col("n") / F.lit(1000.0)).alias("cost_factor"),
        )
    )


def monthly_bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bill per month: three lines and a total that need not agree."""
    start = F.date_trunc("month", "o_orderdate")
    line = lambda r: F.sum(F.when(F.col("o_orderkey") % 4 == r, F.round("o_totalprice")))
    return (
        table(spark, sf_dir, "orders")
        .groupBy(start.alias("period_from"))
        .agg(
            line(0).alias("storage"),
            line(1).alias("network_read"),
            line(2).alias("network_write"),
            F.sum(F.round("o_totalprice")).alias("all_lines"),
        )
        .select(
            F.date_format("period_from", "yyyy-MM").alias("bill_id"),
            "period_from",
            (F.col("period_from") + F.expr("INTERVAL 1 MONTH")).alias("period_to"),
            "storage",
            "network_read",
            "network_write",
            F.when(F.month("period_from") % 2 == 0, F.col("all_lines"))
            .otherwise(F.col("storage") + F.col("network_read") + F.col("network_write"))
            .alias("total"),
        )
    )


# -- part and supplier: topics, users, access lists, feeders -----------------------------

ANNOTATION_PREFIX = "metering-context/"


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "part")
        .groupBy(F.concat_ws(".", "p_brand", "p_type").alias("topic"))
        .agg(F.max("p_size").cast("string").alias("_size"), F.min("p_name").alias("_app"))
        .select(
            "topic",
            F.create_map(
                F.lit(ANNOTATION_PREFIX + "size"),
                F.col("_size"),
                F.lit(ANNOTATION_PREFIX),
                F.lit("ignored"),
                F.lit("other/app"),
                F.col("_app"),
            ).alias("annotations"),
        )
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    group = F.concat(F.lit("group-"), F.col("s_nationkey"))
    none = F.create_map().cast("map<string,string>")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("user-"), key).alias("user"),
        F.when(key % 11 == 0, none)
        .otherwise(F.create_map(F.lit(ANNOTATION_PREFIX + "application"), group))
        .alias("annotations"),
        F.when(key % 13 == 0, "opa").otherwise("simple").alias("authorization"),
    )


def acls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By supplier mod 5: literal allow; prefix allow; allow on all topics; allow all but deny
    on a brand; nothing. Some use the old single operation field."""
    supplier = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    brand = F.concat(F.lit("Brand#"), key % 25 + 1)
    literal = F.concat(brand, F.lit(".ECONOMY"))
    prefix = F.concat(F.lit("Brand#"), key % 9 + 1)
    ops = lambda *names: F.array(*[F.lit(n) for n in names])
    no_ops = F.array().cast("array<string>")

    def rule(kind, name, pattern, operations, operation=None):
        return F.struct(
            F.lit(kind).alias("rule_type"),
            name.alias("resource_name"),
            F.lit(pattern).alias("pattern_type"),
            operations.alias("operations"),
            F.lit(operation).cast("string").alias("operation"),
        )

    star = F.lit("*")
    rules = (
        F.when(
            key % 5 == 0,
            F.array(
                rule("ALLOW", literal, "LITERAL", ops("READ", "DESCRIBE")),
                rule("DENY", literal, "LITERAL", ops("WRITE", "ALTER")),
            ),
        )
        .when(key % 5 == 1, F.array(rule("ALLOW", prefix, "PREFIX", no_ops, "Write")))
        .when(key % 5 == 2, F.array(rule("ALLOW", star, "PREFIX", ops("ALL"))))
        .when(
            key % 5 == 3,
            F.array(
                rule("ALLOW", star, "LITERAL", ops("READ", "WRITE")),
                rule("DENY", prefix, "PREFIX", no_ops, "All"),
                rule("ALLOW", literal, "LITERAL", ops("READ"), "Write"),
            ),
        )
        .otherwise(F.array(rule("ALLOW", literal, "LITERAL", ops("DESCRIBE"), "Read")))
    )
    return supplier.select(
        F.concat(F.lit("user-"), key).alias("user"), F.explode(rules).alias("_r")
    ).select("user", "_r.rule_type", F.lit("topic").alias("resource_type"), "_r.resource_name",
             "_r.pattern_type", "_r.operations", "_r.operation")


def schema_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(
        F.array(F.lit("-key"), F.lit("-value"), F.lit(""), F.lit("-value-key")),
        (F.col("p_partkey") % 4 + 1).cast("int"),
    )
    return table(spark, sf_dir, "part").select(
        F.concat("p_brand", F.lit("-"), "p_type", kind).alias("subject"),
        F.col("p_size").alias("version"),
    )


def topic_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            F.concat(F.lit("supplier-"), "l_suppkey").alias("topic"),
            F.col("l_linenumber").alias("partition"),
        )
        .distinct()
    )


def vendor_pages(spark: SparkSession, sf_dir: str, page_size: int = 100) -> DataFrame:
    """The events as pages of a vendor's metrics API, one hundred data points a page."""
    event, user = F.col("event_id"), F.col("user_id")
    group_by = F.element_at(
        F.array(F.lit("metric.principal_id"), F.lit("metric.topic"), F.lit("metric.other")),
        (F.floor(event / page_size) % 3 + 1).cast("int"),
    )
    owner = F.concat(F.lit("id-"), user)
    point = F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.floor("value").alias("value"),
        F.when(group_by == "metric.principal_id", owner).alias("metric.principal_id"),
        F.when(group_by == "metric.topic", owner).alias("metric.topic"),
    )
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.floor(event / page_size).alias("page"), group_by.alias("group_by"))
        .agg(F.to_json(F.struct(F.collect_list(point).alias("data"))).alias("body"))
        .select(
            "body",
            F.lit("io.vendor.server/sent_bytes").alias("metric_name"),
            "group_by",
            F.lit("lkc-1").alias("cluster_id"),
        )
    )
