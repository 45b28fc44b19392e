"""Required texts of patterns, the index of names, validity trees and the as-of merge."""

import random
import re
from datetime import datetime, timedelta

import pytest
from helpers import raw, rules, ts
from pyspark.sql import functions as F

from tallyspark.functions.normalize import normalize
from tallyspark.operators import factors, labels, pricing
from tallyspark.operators.asof import as_of


@pytest.mark.parametrize(
    "regex,clauses",
    [
        (".*-ORDERS-.*", [["-orders-"]]),
        (r"[.]*\.app(1|22)\..*", [[".app"], ["1", "22"], ["."]]),
        ("(a|bcd|.)x+y", [["x"], ["xy"]]),
        ("a?b*cd{0,3}(ef)?", [["c"]]),
        ("ab{2}c", [["ab"], ["bc"]]),
        ("(?:left|right)side", [["left", "right"], ["side"]]),
        ("(?=ahead)mid(?<name>dle)(?!no)", [["mid"], ["dle"]]),
        ("^start$|^end$", [["end", "start"]]),
        ("x|", []),
        (".*", []),
        (r"\Qabc\E", []),
        ("(?x) a b", []),
        ("[ab]c[d]e", [["cde"]]),
        ("[^a]]b", [["]b"]]),
        (r"\x41b", []),
        ("a(b", []),
    ],
)
def test_required_factors(regex, clauses):
    assert factors.required_factors(regex) == clauses


def test_every_match_contains_a_text_of_each_clause():
    rng = random.Random(11)

    def pattern(depth=0):
        parts = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.randint(0, 7 if depth < 2 else 5)
            item = rng.choice("abc") if kind < 4 else rng.choice([".", "[ab]", r"\.", "[c]"]) if kind < 6 else "(" + pattern(depth + 1) + ")" if kind == 6 else "(?:" + pattern(depth + 1) + "|" + pattern(depth + 1) + ")"
            parts.append(item + rng.choice(["", "", "", "?", "*", "+", "{2}", "{0,1}", "+?"]))
        return "".join(parts)

    names = ["".join(rng.choice("abc.") for _ in range(rng.randint(0, 9))) for _ in range(400)]
    useful = 0
    for _ in range(300):
        rx = pattern()
        clauses = factors.required_factors(rx)
        useful += bool(clauses)
        for name in names:
            if re.fullmatch(rx, name):
                assert all(any(t in name for t in clause) for clause in clauses), (rx, name, clauses)
    assert useful > 150


def open_rules(n):
    """Patterns without a plain head; some have no required text at all."""
    made = []
    for i in range(n):
        rx = [f".*-q{i}-(.*)", f"[a-z]+{i % 50}x(eu|us)", f".*(z{i}|y{i % 7}q).*", f"(.)*{i}", "(.+)e{1,2}"][i % 5]
        made.append((f"r{i:04}", f"2023-01-{1 + i % 28:02}T00:00:00", None, None, "TOPIC", rx, {f"k{i % 4}": f"v{i}-$1" if i % 5 < 4 else f"v{i}"}))
    return made


def test_many_open_rules_equal_rule_by_rule(spark):
    rows = open_rules(300) + [(f"w{i}", "2022-01-01T00:00:00", None, None, "TOPIC", f"[a-z0-9-]{{{i}}}", {"w": str(i)}) for i in range(1, 9)]
    rng = random.Random(5)
    names = [f"{rng.choice(['ab', 'AB', 'q'])}-q{rng.randint(0, 330)}-{rng.choice(['eu', 'us', 'tree'])}" for _ in range(60)]
    names += [f"abc{i}x{rng.choice(['eu', 'US', 'no'])}" for i in range(55)] + [f"z{i}" for i in range(0, 300, 9)] + ["y3q", "", "e", "Hello E"]
    compiled = labels.compile_rules(rules(spark, rows), 0)
    assert compiled.open_patterns is None and compiled.n_wild >= 8 and compiled.wild_patterns is not None
    table = spark.createDataFrame([("TOPIC", n) for n in names], "entity_type string, name string")
    found = labels.match_rules(table, compiled)
    got = {(r.name, r.rule_id) for r in found.collect()}
    assert len(got) == found.count()
    want = {(n, r[0]) for n in names for r in rows if re.fullmatch(r[5], n, re.I | re.A)}
    assert got == want and len(want) > 100
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "_block" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_validity_trees_equal_every_instant(spark):
    """Random ranges of one entity: the label at each instant is that of the newest valid rule of each key."""
    rng = random.Random(3)
    base = datetime(2024, 1, 1)
    at = lambda h: None if h is None else (base + timedelta(hours=h)).isoformat()
    ranges, rows = [], []
    for i in range(120):
        low, high = rng.choice([None, rng.randint(0, 300)]), rng.choice([None, rng.randint(0, 300)])
        ranges.append((i, low, high, f"k{rng.randint(0, 2)}"))
        rows.append((f"r{i:03}", at(-1000 + i // 2), at(low), at(high), "TOPIC", "hall.*|never", {ranges[-1][3]: str(i)}))
    compiled = labels.compile_rules(rules(spark, rows), 0)
    table = spark.createDataFrame([("TOPIC", "hall1"), ("TOPIC", "none")], "entity_type string, name string")
    segments = labels.context_segments(table, compiled).collect()
    assert {s.name for s in segments} == {"hall1"}
    instants = [base + timedelta(hours=h, minutes=m) for h in range(-1, 302) for m in (0, 30)]
    for t in instants:
        hour = (t - base).total_seconds() / 3600
        want = {}
        for i, low, high, key in ranges:
            if (low is None or low <= hour) and (high is None or hour < high):
                want[key] = str(i)
        found = [s.context for s in segments if s.seg_from <= t < s.seg_until]
        assert len(found) <= 1 and (found[0] if found else {}) == want
    many = labels.enrich(
        spark.createDataFrame([("TOPIC", n, t) for n in ("hall1", "none") for t in instants] + [(None, "x", None)], "entity_type string, name string, timestamp timestamp"),
        labels.context_segments(table, compiled), many=True,
    )
    few = labels.enrich(many.drop("context"), labels.context_segments(table, compiled))
    key = lambda r: (str(r.name), str(r.timestamp), sorted(r.context.items()))
    assert sorted(map(key, many.collect())) == sorted(map(key, few.collect()))


def test_ten_thousand_versions_of_an_entity_stay_linear(spark):
    n = 10_000
    changes = spark.range(n).select(
        F.concat(F.lit("r"), F.lpad("id", 5, "0")).alias("rule_id"),
        F.expr("timestamp'2020-01-01' + make_interval(0, 0, 0, 0, cast(id as int))").alias("creation_time"),
        F.expr("timestamp'2022-01-01' + make_interval(0, 0, 0, 0, cast(id as int))").alias("valid_from"),
        F.expr("timestamp'2022-01-01' + make_interval(0, 0, 0, 0, cast(id + 50 as int))").alias("valid_until"),
        F.lit("TOPIC").alias("entity_type"), F.lit("hall.*").alias("regex"), F.create_map(F.lit("v"), F.col("id").cast("string")).alias("context"),
    )
    compiled = labels.compile_rules(changes)
    assert compiled.boundaries is None
    hours = [0, 1, 49, 50, 5000, 9999, 10_048, 10_049]
    df = raw(spark, [((datetime(2022, 1, 1) + timedelta(hours=h)).isoformat(), "m", {"gauge": "1"}, {"topic": "hall7"}) for h in hours])
    labelled = labels.label(normalize(df), compiled)
    got = {r.timestamp: r.context.get("v") for r in labelled.collect()}
    assert [got[datetime(2022, 1, 1) + timedelta(hours=h)] for h in hours] == ["0", "1", "49", "50", "5000", "9999", "9999", None]
    nodes = labels.match_rules(spark.createDataFrame([("TOPIC", "hall7")], "entity_type string, name string"), compiled)
    assert nodes.count() == n


def test_as_of_equals_a_search(spark):
    rng = random.Random(8)
    base = datetime(2024, 1, 1)
    moment = lambda: base + timedelta(hours=rng.randint(0, 24 * 9))
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([moment(), moment(), None])) for i in range(400)]
    rows += rows[:5]
    versions = {(rng.choice("ab"), moment()): rng.choice([rng.randint(0, 99), None]) for _ in range(40)}
    left = spark.createDataFrame(rows, "_salt int, k string, _at timestamp")
    right = spark.createDataFrame([(k, t, v) for (k, t), v in versions.items()] + [(None, base, 1), ("a", None, 2)], "k string, since timestamp, v int")
    for width in ("1 day", "1 hour", "100 days"):
        got = sorted(map(str, as_of(left, right, ["k"], "_at", "since", ["v"], width, 3).collect()))
        want = []
        for i, k, t in rows:
            before = [u for (q, u) in versions if q == k and t is not None and u <= t]
            value = versions[(k, max(before))] if before else None
            want.append(f"Row(_salt={i!r}, k={k!r}, _at={t!r}, v={value!r})")
        assert got == sorted(want)


def test_prices_in_force_do_not_gather_a_metric(spark):
    windows = spark.createDataFrame([(ts("2024-01-05T00:00:00"), "m", 2.0), (ts("2023-12-31T00:00:00"), "m", 2.0), (ts("2024-03-05T00:00:00"), "m", 2.0), (ts("2024-03-05T00:00:00"), "other", 1.0)], "start_time timestamp, initial_metric_name string, value double")
    prices = spark.createDataFrame([("m", ts("2024-01-01T00:00:00"), 1.0, 0.5), ("m", ts("2024-02-01T00:00:00"), 0.0, 10.0)], "metric_name string, creation_time timestamp, base_cost double, cost_factor double")
    priced = pricing.backtest_prices(windows, prices)
    assert sorted((str(r.start_time)[:10], r.initial_metric_name, r.cost) for r in priced.collect()) == [("2023-12-31", "m", None), ("2024-01-05", "m", 2.0), ("2024-03-05", "m", 20.0), ("2024-03-05", "other", None)]
    assert priced.columns == ["start_time", "initial_metric_name", "value", "cost"]
    joins = [x for x in priced._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    assert all("_slice" in x for x in joins)  # no join on the metric alone
