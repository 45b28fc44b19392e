"""Deriving topic rules from annotations and access-control lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.maps import canonical_json, put
from tallyspark.session import cut_lineage

# Operation names as the access lists spell them.
ACL_OPERATIONS = (
    "Read",
    "Write",
    "Delete",
    "Create",
    "Describe",
    "Alter",
    "AlterConfigs",
    "DescribeConfigs",
    "ClusterAction",
    "IdempotentWrite",
    "All",
)
EVERY_TOPIC = "*"


@dataclass(frozen=True)
class AccessConfig:
    annotation_prefix: str = "metering-context/"
    group_key: str = "application"
    group_fallback: str = "unknown"
    readers_key: str = "readers"
    writers_key: str = "writers"
    regex_prefix: str = ""
    regex_suffix: str = ""


def annotation_context(annotations: Column, prefix: str) -> Column:
    """Entries whose key is longer than and starts with ``prefix``, prefix removed."""
    owned = F.map_filter(
        annotations, lambda k, _: k.startswith(prefix) & (F.length(k) > len(prefix))
    )
    return F.transform_keys(owned, lambda k, _: F.substring(k, F.lit(len(prefix) + 1), F.length(k)))


def acl_operations(operations: Column, legacy: Column) -> Column:
    """The operation list, else the old single field by its spelled name, else nothing."""
    single = F.when(
        legacy.isin(*ACL_OPERATIONS), F.array(F.upper(legacy))
    ).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(operations) > 0, operations).otherwise(single)


def _scope() -> Column:
    """Whether a rule is for any topic, a prefix or a name; null for other patterns."""
    return (
        F.when(F.col("resource_name") == EVERY_TOPIC, "any")
        .when(F.upper("pattern_type") == "PREFIX", "prefix")
        .when(F.upper("pattern_type") == "LITERAL", "literal")
    )


# an empty prefix covers every topic, as the wildcard does
_GENERAL = "(scope = 'any' or (scope = 'prefix' and resource_name = ''))"


def _named_by(names: DataFrame, rules: DataFrame) -> DataFrame:
    """(topic, scope, resource_name) of the names with what may name them in ``rules``.

    Literal rules meet the names, prefix rules the prefixes of the names, in one equi-join;
    only the lengths that some prefix rule has are cut, and they are few.
    """
    prefixes = rules.filter("scope = 'prefix' and resource_name <> ''")
    lengths = sorted(r.n for r in prefixes.select(F.length("resource_name").alias("n")).distinct().collect())
    cuts = F.transform(
        F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("topic")),
        lambda n: F.struct(
            F.lit("prefix").alias("scope"),
            F.substring(F.col("topic"), F.lit(1), n).alias("resource_name"),
        ),
    )
    whole = F.struct(F.lit("literal").alias("scope"), F.col("topic").alias("resource_name"))
    return names.select("topic", F.inline(F.array_append(cuts, whole)))


def _topic_rules(users: DataFrame, acls: DataFrame) -> DataFrame:
    simple = users.filter(F.col("authorization") == "simple").select("user")
    ops = acl_operations(F.col("operations"), F.col("operation"))
    covers = lambda op: F.array_contains(ops, op) | F.array_contains(ops, "ALL")
    is_kind = lambda kind: F.col("rule_type") == kind
    return (
        acls.filter(F.col("resource_type") == "topic")
        .join(simple, "user", "left_semi")
        .select(
            "user",
            "resource_name",
            _scope().alias("scope"),
            (is_kind("ALLOW") & covers("READ")).alias("allow_read"),
            (is_kind("DENY") & covers("READ")).alias("deny_read"),
            (is_kind("ALLOW") & covers("WRITE")).alias("allow_write"),
            (is_kind("DENY") & covers("WRITE")).alias("deny_write"),
        )
        .filter("scope is not null and (allow_read or deny_read or allow_write or deny_write)")
    )


_FLAGS = ("allow_read", "deny_read", "allow_write", "deny_write")


def _can(allow: str, deny: str) -> Column:
    return F.col(allow) & ~F.col(deny)


def _digest(text: str) -> Column:
    """Stands for a text of any length where rows meet and are grouped."""
    return F.unhex(F.sha2(text, 256))


def _resolve(topics: DataFrame, users: DataFrame, acls: DataFrame):
    """(by_topic, everywhere): answers for pairs some rule names, and per user the answer for
    all other topics. ``by_topic`` also carries the user's answer elsewhere (any_*).

    Pairs are many and names may be long, so pairs carry digests; the names are joined back last."""
    rules = _topic_rules(users, acls)
    flags = [F.bool_or(f).alias(f) for f in _FLAGS]
    merged = rules.groupBy("user", "scope", "resource_name").agg(*flags)
    names = topics.select("topic").distinct()

    general = merged.filter(_GENERAL).groupBy("user").agg(*flags)
    keys = _named_by(names, merged).select(_digest("topic").alias("_name"), "scope", _digest("resource_name").alias("_resource"))
    named = merged.filter(f"not {_GENERAL}").select("user", "scope", _digest("resource_name").alias("_resource"), *_FLAGS)
    # dealt out by their number before they are grouped: few rules and names may make many pairs in one task
    special = keys.join(named, ["scope", "_resource"]).repartition("_name", "user").groupBy("_name", "user").agg(*flags)

    other = general.select(F.col("user").alias("_user"), *[F.col(f).alias(f"_{f}") for f in _FLAGS])
    no = F.lit(False)
    by_topic = (
        special.join(other, F.col("user") == F.col("_user"), "left")
        .withColumns({f"_{f}": F.coalesce(f"_{f}", no) for f in _FLAGS})
        .withColumns({f: F.col(f) | F.col(f"_{f}") for f in _FLAGS})
        .join(names.withColumn("_name", _digest("topic")), "_name")
        .select(
            "topic",
            "user",
            _can("allow_read", "deny_read").alias("can_read"),
            _can("allow_write", "deny_write").alias("can_write"),
            _can("_allow_read", "_deny_read").alias("any_read"),
            _can("_allow_write", "_deny_write").alias("any_write"),
        )
    )
    everywhere = general.select(
        "user",
        _can("allow_read", "deny_read").alias("can_read"),
        _can("allow_write", "deny_write").alias("can_write"),
    )
    return by_topic, everywhere


def topic_access(topics: DataFrame, users: DataFrame, acls: DataFrame) -> DataFrame:
    """(topic, user, can_read, can_write): allowed by some rule and denied by none.

    A user with rules for every topic has one row with topic ``*``, its answer wherever no
    row of that user names the topic; so users are never multiplied with all topics.
    """
    by_topic, everywhere = _resolve(topics, users, acls)
    general = everywhere.select(F.lit(EVERY_TOPIC).alias("topic"), *everywhere.columns)
    return by_topic.drop("any_read", "any_write").unionByName(general)


def user_groups(users: DataFrame, config: AccessConfig) -> DataFrame:
    context = annotation_context(F.col("annotations"), config.annotation_prefix)
    group = F.coalesce(context[config.group_key], F.lit(config.group_fallback))
    return users.select("user", group.alias("group"))


def _group_lists(topics: DataFrame, users: DataFrame, acls: DataFrame, config) -> DataFrame:
    """(topic, readers, writers): distinct groups with access, sorted, comma-joined.

    A group is in when a member is allowed by name, or when more members are allowed
    everywhere than the topic turns away.
    """
    groups = user_groups(users, config)
    by_topic, everywhere = _resolve(topics, users, acls)
    sizes = (
        everywhere.join(groups, "user")
        .groupBy("group")
        .agg(*[F.count_if(f"can_{op}").alias(f"{op}_everywhere") for op in ("read", "write")])
    )
    counted = (
        by_topic.join(groups, "user")
        .groupBy("topic", "group")
        .agg(
            *[F.count_if(f"can_{op}").alias(f"{op}_in") for op in ("read", "write")],
            *[
                F.count_if(~F.col(f"can_{op}") & F.col(f"any_{op}")).alias(f"{op}_refused")
                for op in ("read", "write")
            ],
        )
        .join(sizes, "group", "left")
    )
    empty = F.array().cast("array<string>")
    lists, members = [], {}
    for op in ("read", "write"):
        inside = F.col(f"{op}_in") > 0
        outside = ~inside & (F.coalesce(f"{op}_everywhere", F.lit(0)) <= F.col(f"{op}_refused"))
        lists.append(F.collect_set(F.when(inside, F.col("group"))).alias(f"_{op}_in"))
        lists.append(F.collect_set(F.when(outside, F.col("group"))).alias(f"_{op}_out"))
        default = F.collect_set(F.when(F.col(f"{op}_everywhere") > 0, F.col("group")))
        # one row: the groups with access to everything
        members[op] = F.array_except(
            F.array_union(
                F.coalesce(f"_{op}_in", empty), sizes.agg(default.alias("d")).scalar()
            ),
            F.coalesce(f"_{op}_out", empty),
        )
    named = counted.groupBy("topic").agg(*lists)
    text = {op: F.array_join(F.sort_array(m), ",") for op, m in members.items()}
    return (
        topics.select("topic")
        .join(named, "topic", "left")
        .select("topic", text["read"].alias("readers"), text["write"].alias("writers"))
    )


def topic_context(
    topics: DataFrame, users: DataFrame, acls: DataFrame, config: AccessConfig = AccessConfig()
) -> DataFrame:
    """(topic, context): the topic's own annotations plus its reader and writer groups."""
    lists = _group_lists(topics, users, acls, config)
    own = annotation_context(F.col("annotations"), config.annotation_prefix)
    context = put(
        put(own, config.readers_key, F.col("readers")), config.writers_key, F.col("writers")
    )
    return topics.join(lists, "topic").select("topic", context.alias("context"))


def generate_rules(
    topic_contexts: DataFrame, created: Column, config: AccessConfig = AccessConfig()
) -> DataFrame:
    """One topic rule per topic; its regex is the name with plain dots, in prefix and suffix."""
    name = F.replace("topic", F.lit("."), F.lit("[.]"))
    unbounded = F.lit(None).cast("timestamp")
    return topic_contexts.select(
        F.col("topic").alias("rule_id"),
        created.alias("creation_time"),
        unbounded.alias("valid_from"),
        unbounded.alias("valid_until"),
        F.lit("TOPIC").alias("entity_type"),
        F.concat(F.lit(config.regex_prefix), name, F.lit(config.regex_suffix)).alias("regex"),
        "context",
    )


def changed_rules(new: DataFrame, current: DataFrame) -> DataFrame:
    """The new rules whose regex or context differs from the current rule of the same id."""
    old = current.select(
        F.col("rule_id").alias("_id"),
        F.col("regex").alias("_regex"),
        canonical_json(F.col("context")).alias("_json"),
    )
    same = F.col("regex").eqNullSafe(F.col("_regex")) & canonical_json(F.col("context")).eqNullSafe(
        F.col("_json")
    )
    return (
        new.join(old, F.col("rule_id") == F.col("_id"), "left")
        .filter(F.col("_id").isNull() | ~same)
        .select(*new.columns)
    )


def recalculate(
    topics: DataFrame,
    users: DataFrame,
    acls: DataFrame,
    current: DataFrame,
    created: Column,
    config: AccessConfig = AccessConfig(),
) -> DataFrame:
    """All topics anew; only the rules that changed come out."""
    contexts = topic_context(topics, users, acls, config)
    return changed_rules(generate_rules(contexts, created, config), current)


def _differing(new: DataFrame, old: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that one side has more often than the other. One grouping; nulls equal each other."""
    sides = [df.select(*columns, F.lit(n).alias("_side")) for df, n in ((new, 1), (old, -1))]
    return sides[0].unionByName(sides[1]).groupBy(*columns).agg(F.sum("_side").alias("_side")).filter("_side <> 0").drop("_side")


_ACL_COLUMNS = ["user", "rule_type", "resource_type", "resource_name", "pattern_type", "operations", "operation"]


def touched_topics(
    topics: DataFrame,
    users: DataFrame,
    acls: DataFrame,
    old_topics: DataFrame,
    old_users: DataFrame,
    old_acls: DataFrame,
) -> DataFrame:
    """Topics of ``topics`` whose rule may differ from the one that the old tables gave.

    Those are new topics, topics with other annotations, and what a changed access rule names or a
    rule, old or new, of a changed user. A changed rule for every topic touches all of them.
    """
    text = lambda df: df.withColumn("annotations", canonical_json(F.col("annotations")))
    own = _differing(text(topics), text(old_topics), ["topic", "annotations"]).select("topic")
    people = _differing(text(users), text(old_users), ["user", "annotations", "authorization"]).select("user").distinct()
    theirs = acls.select(*_ACL_COLUMNS).unionByName(old_acls.select(*_ACL_COLUMNS)).join(people, "user", "left_semi")
    changed = _differing(acls, old_acls, _ACL_COLUMNS).unionByName(theirs).filter("resource_type = 'topic'")
    scopes = cut_lineage(changed.select(_scope().alias("scope"), "resource_name").distinct())
    names = topics.select("topic").distinct()
    if not scopes.filter(_GENERAL).isEmpty():
        return names
    named = _named_by(names, scopes).join(scopes, ["scope", "resource_name"], "left_semi").select("topic")
    return names.join(named.unionByName(own), "topic", "left_semi")


def recalculate_changes(
    topics: DataFrame,
    users: DataFrame,
    acls: DataFrame,
    old: tuple[DataFrame, DataFrame, DataFrame],
    current: DataFrame,
    created: Column,
    config: AccessConfig = AccessConfig(),
) -> DataFrame:
    """What ``recalculate`` gives where ``current`` are the rules of ``old`` (topics, users, access
    lists as they were), from the touched topics alone."""
    touched = topics.join(touched_topics(topics, users, acls, *old), "topic", "left_semi")
    return recalculate(touched, users, acls, current, created, config)
