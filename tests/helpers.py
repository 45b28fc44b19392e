from tallyspark import schemas as S


def ts(text):
    from datetime import datetime

    return datetime.fromisoformat(text)


def raw(spark, rows):
    """rows: (event_time, name, fields, tags[, timestamp])"""
    data = [(ts(r[0]), ts(r[4] if len(r) > 4 else r[0]), r[1], r[2], r[3]) for r in rows]
    return spark.createDataFrame(data, S.RAW)


def rules(spark, rows):
    """rows: (rule_id, creation_time, valid_from, valid_until, entity_type, regex, context)"""
    when = lambda t: None if t is None else ts(t)
    data = [(r[0], when(r[1]), when(r[2]), when(r[3]), *r[4:]) for r in rows]
    return spark.createDataFrame(data, S.RULES)


def prices(spark, rows):
    return spark.createDataFrame(rows, "metric_name STRING, base_cost DOUBLE, cost_factor DOUBLE")


def facts(spark, rows):
    """rows: (start, end, metric, value, context, name, entity_type)"""
    from tallyspark.sources.facts import to_facts

    data = [(ts(a), ts(b), kind, name, m, float(v), "{}", c) for a, b, m, v, c, name, kind in rows]
    schema = (
        "start_time TIMESTAMP, end_time TIMESTAMP, entity_type STRING, name STRING, "
        f"initial_metric_name STRING, value DOUBLE, tags STRING, context {S.MAP}"
    )
    return to_facts(spark.createDataFrame(data, schema))
