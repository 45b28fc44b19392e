"""Table shapes, as DDL strings that every reader, writer and test shares."""

MAP = "MAP<STRING, STRING>"

# payload of one raw record as it arrives in JSON; ``timestamp`` is epoch or ISO text
RAW_JSON = f"timestamp STRING, name STRING, fields {MAP}, tags {MAP}"

# ``event_time`` drives windows, ``timestamp`` drives the validity of rules
RAW = f"event_time TIMESTAMP, timestamp TIMESTAMP, name STRING, fields {MAP}, tags {MAP}"

RULES = (
    "rule_id STRING, creation_time TIMESTAMP, valid_from TIMESTAMP, valid_until TIMESTAMP, "
    f"entity_type STRING, regex STRING, context {MAP}"
)

PRICES = "metric_name STRING, creation_time TIMESTAMP, base_cost DOUBLE, cost_factor DOUBLE"

# windowed, priced row: the main fact
WINDOWED = (
    "start_time TIMESTAMP, end_time TIMESTAMP, entity_type STRING, name STRING, "
    f"initial_metric_name STRING, value DOUBLE, cost DOUBLE, tags STRING, context {MAP}"
)

# stored fact
FACTS = (
    "start_time TIMESTAMP, end_time TIMESTAMP, initial_metric_name STRING, entity_type STRING, "
    f"name STRING, tags STRING, context {MAP}, context_json STRING, value DOUBLE, cost DOUBLE, "
    "target STRING, row_id STRING"
)

# file exchange form of a fact: maps as JSON text
EXPORT = (
    "start_time TIMESTAMP, end_time TIMESTAMP, initial_metric_name STRING, entity_type STRING, "
    "name STRING, tags STRING, context STRING, value DOUBLE, target STRING, id STRING"
)

USERS = f"user STRING, annotations {MAP}, authorization STRING"
ACLS = (
    "user STRING, rule_type STRING, resource_type STRING, resource_name STRING, "
    "pattern_type STRING, operations ARRAY<STRING>, operation STRING"
)
TOPICS = f"topic STRING, annotations {MAP}"

ENTITY_TYPES = ("TOPIC", "PRINCIPAL", "UNKNOWN")
