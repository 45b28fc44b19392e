import pytest
from helpers import raw, rules, ts
from pyspark.sql import functions as F

from tallyspark.functions.normalize import normalize
from tallyspark.operators import labels as L

OLD, NEW = "2023-01-01T00:00:00", "2023-06-01T00:00:00"
AT = "2024-01-10T00:00:00"

# every test runs with rules as constants and with rules as joined rows
both = pytest.mark.parametrize("max_inline", [L.INLINE_RULES, 0], ids=["inline", "joined"])


def contexts(spark, rule_rows, names, max_inline, kind="TOPIC"):
    tag = {"TOPIC": "topic", "PRINCIPAL": "principal_id"}[kind]
    rows = [n if isinstance(n, tuple) else (n, AT) for n in names]
    df = raw(spark, [(at, "m", {"gauge": "1.5"}, {tag: n}) for n, at in rows])
    compiled = L.compile_rules(rules(spark, rule_rows), max_inline)
    got = L.label(normalize(df), compiled).collect()
    assert len(got) == len(rows)
    by_key = {(r.name, r.timestamp): r.context for r in got}
    return [by_key[(n, ts(at))] for n, at in rows]


@both
def test_rules_with_different_keys_add_up(spark, max_inline):
    floors = [(f"floor{n}", OLD, None, None, "TOPIC", f"hall{n}/.*", {"floor": str(n)}) for n in (1, 2)]
    lamps = [("lamps", OLD, None, None, "TOPIC", ".*/lamp[0-9]", {"device": "lamp", "watts": "9"})]
    got = contexts(spark, floors + lamps, ["hall1/lamp3", "hall2/door", "yard/lamp1", "yard/gate"], max_inline)
    assert got == [
        {"floor": "1", "device": "lamp", "watts": "9"},
        {"floor": "2"},
        {"device": "lamp", "watts": "9"},
        {},
    ]


@both
def test_each_key_has_its_own_newest_rule(spark, max_inline):
    """Rule number i sets the keys that divide i, and was made in hour i."""
    numbers = range(2, 31)
    rows = [
        (f"r{i:02}", f"2023-04-{1 + i // 24:02}T{i % 24:02}:00:00", None, None, "TOPIC", f"bell({'|' if i % 2 else ''}tower)?",
         {f"by{k}": str(i) for k in (2, 3, 5, 7) if i % k == 0})
        for i in numbers
    ]
    last = lambda k, odd: str(max(i for i in numbers if i % k == 0 and (odd or i % 2 == 0)))
    got = contexts(spark, rows, ["bell", "belltower"], max_inline)
    assert got[0] == {f"by{k}": last(k, True) for k in (2, 3, 5, 7)}
    assert got[1]["by2"] == "30" and got[1]["by5"] == "30"


@both
def test_null_entries_and_null_ids(spark, max_inline):
    rows = [
        ("a", OLD, None, None, "TOPIC", "p.*", {"k": "old", "only": None}),
        ("b", NEW, None, None, "TOPIC", "pq", {"k": None}),
        (None, NEW, None, None, "TOPIC", "p.*", {"j": "nameless"}),
        ("c", NEW, None, None, "TOPIC", "pq", {"j": "named"}),
        ("d", None, None, None, "TOPIC", "p.*", {"k": "ageless", "z": "ageless"}),
    ]
    got = contexts(spark, rows, ["pq", "pz"], max_inline)
    assert got == [{"k": "old", "j": "named", "z": "ageless"}, {"k": "old", "j": "nameless", "z": "ageless"}]


def test_inline_rules_need_a_bit_each(spark):
    with pytest.raises(ValueError):
        L.compile_rules(rules(spark, []), 64)


@both
def test_equal_times_fall_to_the_greater_id(spark, max_inline):
    pair = [(i, OLD, None, None, "TOPIC", "t", {"k": i}) for i in ("b", "a")]
    assert contexts(spark, pair, ["t"], max_inline) == [{"k": "b"}]


@both
def test_validity_is_half_open(spark, max_inline):
    t1, t2 = "2024-01-01T00:00:00", "2024-02-01T00:00:00"
    got = contexts(
        spark,
        [
            ("1", OLD, None, t1, "TOPIC", "t", {"k": "k1"}),
            ("2", OLD, t1, t2, "TOPIC", "t", {"k": "k2"}),
            ("3", OLD, t2, None, "TOPIC", "t", {"k": "k3"}),
            ("4", "2022-01-01T00:00:00", None, None, "TOPIC", "t", {"base": "b", "k": "hidden"}),
        ],
        [("t", "2023-12-31T23:59:59"), ("t", t1), ("t", "2024-01-31T23:59:59.999999"), ("t", t2)],
        max_inline,
    )
    assert [c["k"] for c in got] == ["k1", "k2", "k2", "k3"]
    assert all(c["base"] == "b" for c in got)


@both
def test_type_must_match(spark, max_inline):
    row = [("1", OLD, None, None, "PRINCIPAL", "t.*", {"k": "v"})]
    assert contexts(spark, row, ["topic"], max_inline) == [{}]
    assert contexts(spark, row, ["tom"], max_inline, "PRINCIPAL") == [{"k": "v"}]


@both
def test_match_is_full_and_ignores_ascii_case(spark, max_inline):
    row = [
        ("1", OLD, None, None, "TOPIC", "my[.]topic", {"literal": "y"}),
        ("2", OLD, None, None, "TOPIC", "my[.](TOP)ic", {"head": "$1"}),
        ("3", OLD, None, None, "TOPIC", "(MY).*", {"open": "$1"}),
        ("4", OLD, None, None, "TOPIC", "topic", {"part": "y"}),
        ("5", OLD, None, None, "TOPIC", "mya*[.]topic", {"optional": "y"}),
    ]
    got = contexts(spark, row, ["My.Topic", "my_topic", "m[.]topic"], max_inline)
    # the open pattern leaves nothing to replace after the first match
    assert got[0] == {"literal": "y", "head": "Top", "open": "My", "optional": "y"}
    assert got[1] == {"open": "my"} and got[2] == {}


@both
def test_templates(spark, max_inline):
    flight = r"([A-Z]{2})(\d+)@(?<gate>[A-F]\d)"
    got = contexts(
        spark,
        [
            ("f", OLD, None, None, "TOPIC", flight,
             {"line": "$1", "no": "#$2", "both": "$2/$1", "whole": "[$0]", "ninth": "$9", "price": r"\$2", "end": "5$"}),
            ("g", NEW, None, None, "TOPIC", "..\\d+@(?<gate>.+)", {"at": "gate ${gate}", "who": "${pilot}"}),
            ("t", NEW, None, None, "TOPIC", "[^#]*", {"copies": "y"}),
        ],
        ["LX318@B7"],
        max_inline,
    )
    assert got == [
        {
            "line": "LX",
            "no": "#318",
            "both": "318/LX",
            "whole": "[LX318@B7]",
            "ninth": "$9",
            "price": "$2",
            "end": "5$",
            "at": "gate B7",
            "who": "${pilot}",
            "copies": "yy",
        }
    ]


@both
def test_brackets_that_are_no_groups(spark, max_inline):
    """Quoted text and nested classes hold brackets; their templates stay text or fill in right."""
    rows = [
        ("q", OLD, None, None, "TOPIC", r"\Q(\E(.*)\Q)\E", {"inner": "<$1>", "second": "$2"}),
        ("n", OLD, None, None, "TOPIC", r"[([x)]](.+)[)]", {"nested": "$1", "missing": "$2"}),
        ("c", OLD, None, None, "TOPIC", r"[(?<deep>].*", {"class": "${deep}"}),
    ]
    (got,) = contexts(spark, rows, ["(oak)"], max_inline)
    assert got == {"inner": "<oak>", "second": "$2", "nested": "oak", "missing": "$2", "class": "${deep}"}


@both
def test_bad_patterns_are_skipped_and_reported(spark, max_inline):
    table = rules(
        spark,
        [
            ("bad", OLD, None, None, "TOPIC", "a(b", {"k": "v"}),
            ("bad2", OLD, None, None, "TOPIC", "other(b", {"k": "v"}),
            ("trick", OLD, None, None, "TOPIC", "a)(b", {"k": "v"}),
            ("good", OLD, None, None, "TOPIC", "a.*", {"k": "v"}),
        ],
    )
    compiled = L.compile_rules(table, max_inline)
    assert {r.rule_id for r in compiled.rejected.collect()} == {"bad", "bad2", "trick"}
    assert [r.rule_id for r in compiled.rules.collect()] == ["good"]


@both
def test_no_rules(spark, max_inline):
    assert contexts(spark, [], ["t"], max_inline) == [{}]


def test_many_open_rules_join_in_blocks(spark):
    """More open patterns than constants allow: the same labels as by brute force."""
    n = L.INLINE_PATTERNS + L.BLOCK_RULES + 20
    table = spark.range(n).select(
        F.concat(F.lit("r"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("rule_id"),
        F.lit("2023-01-01").cast("timestamp").alias("creation_time"),
        F.lit(None).cast("timestamp").alias("valid_from"),
        F.lit(None).cast("timestamp").alias("valid_until"),
        F.lit("TOPIC").alias("entity_type"),
        F.concat(F.lit("(a|b)?x"), F.col("id"), F.lit("y?")).alias("regex"),
        F.create_map(F.lit("id"), F.col("id").cast("string")).alias("context"),
    )
    compiled = L.compile_rules(table)
    assert compiled.inline is None and compiled.open_patterns is None and compiled.n_open == n
    names = spark.range(n).select(
        F.lit("TOPIC").alias("entity_type"), F.concat(F.lit("Ax"), F.col("id"), F.lit("y")).alias("name")
    )
    got = L.match_rules(names, compiled).select("name", "rule_id").collect()
    assert sorted((r.name, r.rule_id) for r in got) == sorted((f"Ax{i}y", f"r{i:04}") for i in range(n))


def test_memory_compiles_only_patterns_that_are_new(spark, tmp_path, monkeypatch):
    compiled, plain = [], L._shape_facts
    monkeypatch.setattr(L, "_shape_facts", lambda s, shapes: compiled.append(sorted(shapes)) or plain(s, shapes))
    first = [
        ("1", OLD, None, None, "TOPIC", "bank[.](\\w+)", {"k": "$1"}),
        ("2", OLD, None, None, "TOPIC", ".*(clerk|desk)[0-9]", {"k": "$1"}),
        ("3", OLD, None, None, "TOPIC", "broken(", {"k": "v"}),
        ("4", OLD, None, None, "TOPIC", "lamp", {"k": "lamp"}),
    ]
    second = [first[0], ("2", NEW, None, None, "TOPIC", ".*(?<who>maid|cook)[0-9]", {"k": "${who}"}), *first[2:]]
    names = spark.createDataFrame([("TOPIC", n) for n in ("bank.x", "a-desk7", "b-cook1", "lamp")], "entity_type STRING, name STRING")

    def found(rows, memory):
        rows = L.compile_rules(rules(spark, rows), 0, memory)
        segments = L.context_segments(names, rows).select("name", "context").collect()
        return sorted((r.name, r.context["k"]) for r in segments), [r.rule_id for r in rows.rejected.collect()]

    memory = str(tmp_path / "memory")
    for rows in (first, second, first):
        got = found(rows, memory)
        assert got == found(rows, None) and got[1] == ["3"]
    in_memory = compiled[::2]  # every other call is the one without a memory
    assert len(in_memory[0]) == 3 and in_memory[1:] == [[".*(?<who>maid|cook)[0-9]"], []]
    factors = spark.read.parquet(f"{memory}/factors")
    assert sorted(r.regex for r in factors.collect()) == [".*(?<who>maid|cook)[0-9]", ".*(clerk|desk)[0-9]"]
    none = [first[3]]
    assert found(none, str(tmp_path / "other")) == ([("lamp", "lamp")], [])


def test_probe_answers_for_both_types(spark):
    compiled = L.compile_rules(
        rules(
            spark,
            [
                ("1", OLD, None, None, "TOPIC", "(\\w)\\w*_(\\w+)", {"short": "$1.$2"}),
                ("2", OLD, None, None, "PRINCIPAL", ".*_clerk", {"role": "clerk"}),
            ],
        )
    )
    strings = spark.createDataFrame([("bank_clerk",), ("desk",)], "s STRING")
    got = L.probe_context(strings, compiled, F.current_timestamp()).collect()
    assert {(r.name, r.entity_type): r.context for r in got} == {
        ("bank_clerk", "TOPIC"): {"short": "b.clerk"},
        ("bank_clerk", "PRINCIPAL"): {"role": "clerk"},
        ("desk", "TOPIC"): {},
        ("desk", "PRINCIPAL"): {},
    }


def test_slots_keep_validity(spark):
    compiled = L.compile_rules(
        rules(spark, [("1", OLD, "2024-01-01T00:00:00", "2024-02-01T00:00:00", "TOPIC", "t", {"k": "v"})])
    )
    moments = ["2023-12-31T23:59:59", "2024-01-01T00:00:00", "2024-01-31T00:00:00", "2024-02-01T00:00:00"]
    df = spark.createDataFrame([(ts(m),) for m in moments], "t TIMESTAMP")
    slots = [r[0] for r in df.orderBy("t").select(F.unix_micros(L.validity_slot(F.col("t"), compiled))).collect()]
    assert slots[1] == slots[2] and len(set(slots)) == 3


def test_rules_that_crowd_one_pattern_are_dealt_out(spark, monkeypatch):
    """Slots of a crowded text or pattern, and days that are numbered apart, give the labels of plain rules."""
    from datetime import datetime, timedelta

    at = lambda i, hours: (datetime(2024, 1, 1) + timedelta(hours=7 * i + hours)).isoformat()
    made = [(f"r{i:03}", at(i % 150, i % 5), at(i % 150, 0), at(i % 150, 30 + i % 3), "TOPIC", rx, {"v": f"{i}", f"k{i % 3}": "x"}) for rx in ("t-.*", ".*-[ab]", "t-a") for i in range(300)]
    some = [*made, ("none", at(0, 0), at(3, 1), at(3, 2), "TOPIC", "t-.*", {})]
    names = spark.createDataFrame([("TOPIC", n, datetime(2024, 1, 1) + timedelta(hours=h)) for n in ("t-a", "t-b", "other-a", "u") for h in range(0, 1200, 5)], "entity_type STRING, name STRING, timestamp TIMESTAMP")
    rows = {}
    for crowd in (10**9, 40):
        monkeypatch.setattr(L, "CROWD", crowd)
        compiled = L.compile_rules(rules(spark, some), max_inline=0)
        assert compiled.boundaries is None and len(compiled.crowds) == (0 if crowd > 40 else 3)
        assert {c[-1] for c in compiled.crowds} <= {8}
        segments = L.context_segments(names, compiled)
        rows[crowd] = sorted((r.name, r.seg_from, r.seg_until, sorted(r.context.items())) for r in segments.collect())
    assert rows[40] == rows[10**9]
    newest = {}
    for r in rows[40]:
        a, b = r[1].isoformat(), r[2].isoformat()
        hits = [m for m in some if m[2] <= a and b <= m[3] and {"t-.*": r[0][:2] == "t-", ".*-[ab]": r[0][-2:] in ("-a", "-b"), "t-a": r[0] == "t-a"}[m[5]]]
        for m in sorted(hits, key=lambda m: (m[1], m[0])):
            newest.setdefault(r[:3], {}).update({k: (m[1], m[0], v) for k, v in m[6].items()})
        assert {k: v for k, v in r[3] if k != "v"} == {k: v[2] for k, v in newest[r[:3]].items() if k != "v"}
        assert dict(r[3])["v"] == newest[r[:3]]["v"][2]
