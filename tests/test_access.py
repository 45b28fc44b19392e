import itertools

import pytest
from helpers import rules
from pyspark.sql import functions as F

from tallyspark import schemas as S
from tallyspark.operators import access as A

GROUP = "metering-context/application"


def tables(spark, topics, users):
    """users: (name, annotations, authorization, [(type, resource, pattern, operations, legacy)])"""
    acls = [
        (u, kind, "topic", res, pattern, ops, legacy)
        for u, _, _, rs in users
        for kind, res, pattern, ops, legacy in rs
    ]
    return (
        spark.createDataFrame([(t, a) for t, a in topics.items()], S.TOPICS),
        spark.createDataFrame([(u, a, auth) for u, a, auth, _ in users], S.USERS),
        spark.createDataFrame(acls, S.ACLS),
    )


def allow_deny(resource, pattern, allowed, denied):
    return [("ALLOW", resource, pattern, allowed, None), ("DENY", resource, pattern, denied, None)]


def user(name, group, rs):
    return (name, {GROUP: group} if group else {}, "simple", rs)


LEDGER, MENU = "bank.ledger", "bistro.menu"
USERS = [
    user("ann", "tellers", [("ALLOW", "bank.", "PREFIX", ["WRITE"], None), ("DENY", LEDGER, "LITERAL", ["DELETE"], None)]),
    user("bob", "tellers", [("DENY", LEDGER, "LITERAL", ["ALL"], None), ("ALLOW", "b", "PREFIX", ["READ"], None)]),
    user("cat", "cooks", [("ALLOW", MENU, "LITERAL", ["ALL"], None)]),
    user("dan", "audit", [("ALLOW", "*", "LITERAL", ["READ"], None), ("DENY", "bistro", "PREFIX", ["READ", "WRITE"], None)]),
    user("eve", "audit", allow_deny("bank", "PREFIX", ["READ", "WRITE"], ["WRITE"])),
    user("fay", "idle", [("ALLOW", LEDGER, "LITERAL", ["DESCRIBE"], None)]),
    ("gus", {GROUP: "guests"}, "token", [("ALLOW", "*", "LITERAL", ["ALL"], None)]),
]


def test_access_matrix(spark):
    args = tables(spark, {LEDGER: {"metering-context/app": "books", "note": "n"}, MENU: {}, "cellar": {}}, USERS)
    got = {r.topic: r.context for r in A.topic_context(*args).collect()}
    assert got == {
        LEDGER: {"app": "books", "readers": "audit", "writers": "tellers"},
        MENU: {"readers": "cooks,tellers", "writers": "cooks"},
        "cellar": {"readers": "audit", "writers": ""},
    }


def test_denials_stay_beside_the_general_grant(spark):
    topics, users, acls = tables(spark, {LEDGER: {}, MENU: {}}, USERS)
    rows = {(r.topic, r.user): r.can_read for r in A.topic_access(topics, users, acls).collect()}
    assert rows[("*", "dan")] is True and rows[(MENU, "dan")] is False and (LEDGER, "dan") not in rows


def test_prefixes_of_any_length(spark):
    long = "n" * 400
    people = [user("ida", "g", [("ALLOW", long, "PREFIX", ["READ"], None)])]
    topics, users, acls = tables(spark, {long + "x": {}, long[1:]: {}}, people)
    assert [(r.topic, r.can_read) for r in A.topic_access(topics, users, acls).collect()] == [(long + "x", True)]


def test_group_stays_while_one_member_is_not_refused(spark):
    general = [("ALLOW", "*", "LITERAL", ["READ"], None)]
    refused = [*general, ("DENY", "secret", "PREFIX", ["READ"], None)]
    users = [user("a", "mixed", general), user("b", "mixed", refused), user("c", "out", refused), user("d", None, general)]
    args = tables(spark, {"secret.1": {}, "open": {}}, users)
    got = {r.topic: r.context["readers"] for r in A.topic_context(*args).collect()}
    assert got == {"secret.1": "mixed,unknown", "open": "mixed,out,unknown"}


def test_access_equals_brute_force(spark):
    topics = ["a", "ab", "abc", "b.c", "*x"]
    scopes = [("*", "LITERAL"), ("a", "PREFIX"), ("ab", "LITERAL"), ("", "PREFIX"), ("b", "LITERAL")]
    users = []
    for i, (one, two) in enumerate(itertools.product(scopes, scopes)):
        for k, (op1, op2) in enumerate([("READ", "READ"), ("ALL", "WRITE")]):
            users.append(user(f"u{i}-{k}", f"g{i}", [("ALLOW", *one, [op1], None), ("DENY", *two, [op2], None)]))
    args = tables(spark, {t: {} for t in topics}, users)

    def applies(scope, topic):
        name, pattern = scope
        return name == "*" or (topic.startswith(name) if pattern == "PREFIX" else topic == name)

    def can(u, topic, op):
        hit = lambda kind: any(
            k == kind and applies((res, pat), topic) and (op in ops or "ALL" in ops) for k, res, pat, ops, _ in u[3]
        )
        return hit("ALLOW") and not hit("DENY")

    rows = A.topic_access(*args).collect()
    named = {(r.topic, r.user): (r.can_read, r.can_write) for r in rows}
    for u, t in itertools.product(users, topics):
        answer = named.get((t, u[0]), named.get(("*", u[0]), (False, False)))
        assert answer == (can(u, t, "READ"), can(u, t, "WRITE")), (u, t)
    lists = {r.topic: r.context for r in A.topic_context(*args).collect()}
    for t in topics:
        want = sorted({u[1][GROUP] for u in users if can(u, t, "READ")})
        assert lists[t]["readers"] == ",".join(want)


@pytest.mark.parametrize(
    "ops, legacy, expected",
    [
        (["READ"], "Write", ["READ"]),
        ([], "Read", ["READ"]),
        (None, "DescribeConfigs", ["DESCRIBECONFIGS"]),
        ([], "READ", []),
        ([], "Unheard", []),
        (None, None, []),
    ],
)
def test_operations(spark, ops, legacy, expected):
    df = spark.createDataFrame([(ops, legacy)], "o ARRAY<STRING>, l STRING")
    assert df.select(A.acl_operations(F.col("o"), F.col("l"))).first()[0] == expected


def test_annotations(spark):
    m = F.create_map(*[F.lit(x) for x in ("p/a", "1", "p/", "2", "q/b", "3", "p/p/c", "4")])
    assert spark.range(1).select(A.annotation_context(m, "p/")).first()[0] == {"a": "1", "p/c": "4"}


def test_generated_rule_and_changes(spark):
    contexts = spark.createDataFrame([(LEDGER, {"a": "1", "b": "2"})], f"topic STRING, context {S.MAP}")
    config = A.AccessConfig(regex_prefix="(eu[.])?", regex_suffix="x?")
    rule = A.generate_rules(contexts, F.lit("2024-01-01").cast("timestamp"), config)
    row = rule.first()
    assert (row.rule_id, row.entity_type, row.regex) == (LEDGER, "TOPIC", "(eu[.])?bank[.]ledgerx?")

    def current(regex, context):
        at = "2020-01-01T00:00:00"
        return rules(spark, [(LEDGER, at, None, None, "TOPIC", regex, context)])

    same, none = current(row.regex, {"b": "2", "a": "1"}), current("z", {}).filter("false")
    assert A.changed_rules(rule, same).count() == 0
    assert A.changed_rules(rule, current("other", {"a": "1", "b": "2"})).count() == 1
    assert A.changed_rules(rule, current(row.regex, {"a": "1"})).count() == 1
    assert A.changed_rules(rule, none).count() == 1


def test_recalculation_publishes_once(spark):
    args = tables(spark, {LEDGER: {}, "hidden": {}}, USERS)
    at = F.lit("2024-01-01").cast("timestamp")
    none = rules(spark, [("none", "2020-01-01T00:00:00", None, None, "TOPIC", "z", {})])
    first = A.recalculate(*args, none, at)
    assert first.count() == 2
    assert A.recalculate(*args, first, at).count() == 0


def changed(spark, seed):
    """Two states of topics, users and access lists with a few differences, none of them for all topics."""
    import random

    rng = random.Random(seed)
    names = [f"{a}.{b}" for a in ("bank", "bar", "bistro", "cellar") for b in ("in", "out", "ledger")]
    scope = lambda: rng.choice([("bank.", "PREFIX"), ("b", "PREFIX"), ("bar.in", "LITERAL"), ("cellar.out", "LITERAL"), ("ba", "PREFIX")])
    rule = lambda: (rng.choice(["ALLOW", "ALLOW", "DENY"]), *scope(), [rng.choice(["READ", "WRITE", "ALL"])], None)
    people = [user(f"u{i}", f"g{i % 4}", [rule() for _ in range(3)]) for i in range(8)]
    people += [user("all", "g9", [("ALLOW", "*", "LITERAL", ["READ"], None), ("DENY", "cellar", "PREFIX", ["READ"], None)])]
    old = tables(spark, {n: {"metering-context/app": n[:2]} for n in names[1:]}, people)
    people = list(people)
    people[0] = (*people[0][:3], [*people[0][3][1:], rule()])
    people[1] = (people[1][0], {GROUP: "moved"}, *people[1][2:])
    people[2] = (*people[2][:2], "token", people[2][3])
    people.pop(3)
    people.append(user("new", "g1", [("ALLOW", "bistro.in", "LITERAL", ["READ"], None)]))
    new = tables(spark, {n: {"metering-context/app": n[:2] + ("x" if n == "cellar.in" else "")} for n in names}, people)
    return old, new


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_partial_recalculation_equals_the_full_one(spark, seed):
    old, new = changed(spark, seed)
    created = F.lit("2024-01-01").cast("timestamp")
    current = A.generate_rules(A.topic_context(*old), created)
    rows = lambda df: sorted((r.rule_id, r.regex, sorted(r.context.items())) for r in df.collect())
    want = rows(A.recalculate(*new, current, created))
    assert want and rows(A.recalculate_changes(*new, old, current, created)) == want
    assert A.recalculate_changes(*new, new, A.generate_rules(A.topic_context(*new), created), created).count() == 0


def test_only_touched_topics_are_worked_out(spark):
    old = tables(spark, {LEDGER: {}, MENU: {}, "cellar": {}, "barn": {}}, USERS)
    more = [*USERS, user("hal", "barons", [("ALLOW", "bar", "PREFIX", ["READ"], None)])]
    new = tables(spark, {LEDGER: {}, MENU: {}, "cellar": {"metering-context/app": "x"}, "barn": {}}, more)
    assert sorted(r.topic for r in A.touched_topics(*new, *old).collect()) == ["barn", "cellar"]
    assert A.touched_topics(*new, *new).count() == 0
    every = tables(spark, {LEDGER: {}, MENU: {}}, [*USERS, user("ivy", "g", [("DENY", "", "PREFIX", ["READ"], None)])])
    assert A.touched_topics(*every, *old).count() == 2


def test_pairs_carry_no_long_names(spark):
    """Pairs of topics and users meet and are grouped by digests, whatever the length of the names."""
    long = "t" * 5000
    topics = spark.createDataFrame([(long + "a", {}), (long + "b", {}), (None, {})], "topic STRING, annotations MAP<STRING, STRING>")
    users = spark.createDataFrame([("u", {}, "simple"), ("v", {}, "simple")], "user STRING, annotations MAP<STRING, STRING>, authorization STRING")
    rule = lambda user, kind, name, pattern: (user, kind, "topic", name, pattern, ["READ"], None)
    acls = spark.createDataFrame(
        [rule("u", "ALLOW", long, "PREFIX"), rule("u", "DENY", long + "b", "LITERAL"), rule("v", "ALLOW", long + "b", "LITERAL")],
        "user STRING, rule_type STRING, resource_type STRING, resource_name STRING, pattern_type STRING, operations ARRAY<STRING>, operation STRING",
    )
    rows = A.topic_access(topics, users, acls)
    assert sorted((r.topic[-1], r.user, r.can_read) for r in rows.collect()) == [("a", "u", True), ("b", "u", False), ("b", "v", True)]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    keys = [line.split("Aggregate [")[1].split("]")[0] for line in plan.splitlines() if "Aggregate [" in line]
    assert not any("user#" in k and "topic#" in k for k in keys) and any("user#" in k and "_name#" in k for k in keys)
