"""Labelling: regex rules with a validity range, newest rule wins per context key.

A small rule set becomes one column expression, without any join (:func:`context_column`).
A larger one is matched against the distinct (entity_type, name) pairs, never against the
metric rows. Its rules fall in three classes, so that there may be as many as entities:

* literal: the regex is a plain text, matched by an equi-join on the folded name;
* head: the regex starts with plain text, matched by an equi-join on that head, with the
  regex as a residual;
* open: anything else, matched by constant patterns while there are few of them. Beyond that a
  rule meets the names that hold a text every match of it must contain, by an equi-join on pieces
  of text (:mod:`tallyspark.operators.factors`). Patterns without any such text, ``.*`` say, stay
  constants, and only if they too are many, a block-partitioned join.

Validity ranges become labels without meeting each other: the instants where the rules of an
entity change are numbered, each rule's range is a few nodes of a binary tree over the numbers,
and a range between two instants looks its rules up along its path to the root.
"""

from __future__ import annotations

import functools
import re
import string
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.functions.maps import compute_once, empty_map, sorted_map
from tallyspark.operators.asof import as_of
from tallyspark.operators.factors import candidate_names, factors_column
from tallyspark.operators.latest import latest_by_key
from tallyspark.session import written

# An unbounded validity: outside any usage, inside what Spark, Parquet and Python can hold.
EARLIEST, LATEST = "1000-01-01 00:00:00", "9999-12-31 00:00:00"

INLINE_RULES = 60  # up to here rules are constants of the plan, one bit each in a BIGINT
INLINE_PATTERNS = 128  # same for the open patterns of a larger rule set
MAX_HEAD = 64  # longest text used as a join key
BLOCK_RULES = 256  # open rules per block beyond INLINE_PATTERNS
NAME_SALTS = 64  # parallel slices of the names per block
CROWD = 50_000  # rules of one text or pattern beyond which they are dealt out
MAX_BOUNDARIES = 256  # validity boundaries that fit into a constant array

_OPEN_LOW, _OPEN_HIGH = -30610224000000000, 253402214400000000  # the same in microseconds

_ESCAPED_DOT = "\u0001"
_META = r"[\\^$.|?*+()\[\]{}]"


def fold(text: Column) -> Column:
    """ASCII-only lower case: what a case-insensitive Java regex treats as equal."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


@dataclass(frozen=True, eq=False)
class CompiledRules:
    """Checked rules plus the few facts about them that choose the join strategy."""

    rules: DataFrame
    rejected: DataFrame
    inline: tuple | None  # every rule, oldest first; None: too many to be constants
    boundaries: tuple | None  # instants where validity changes; None: too many
    head_lengths: tuple[int, ...] = ()
    n_literal: int = 0
    n_open: int = 0
    types: tuple[str, ...] = ()  # entity types that some rule is for
    open_patterns: tuple[tuple[str, str], ...] | None = None  # None: too many
    n_wild: int = 0  # open rules without a text that every match contains
    wild_patterns: tuple[tuple[str, str], ...] | None = None  # of those; None: too many
    crowds: tuple[tuple[str, str, str, int], ...] = ()  # (column, its value, entity type, slots) shared by over CROWD rules

    @property
    def always_valid(self) -> bool:
        """No rule ever starts or ends, so an entity keeps one label."""
        return self.boundaries is not None and set(self.boundaries) <= {_OPEN_LOW, _OPEN_HIGH}


def _with_shape(rules: DataFrame) -> DataFrame:
    regex = F.col("regex")
    masked = F.regexp_replace(regex, r"\[\.\]|\\\.", _ESCAPED_DOT)
    run = F.regexp_extract(masked, r"^\^?([^\\^$.|?*+()\[\]{}]*)", 1)
    after = F.regexp_extract(masked, r"^\^?[^\\^$.|?*+()\[\]{}]*(.?)", 1)
    quoted = regex.contains(_ESCAPED_DOT) | regex.contains("\\Q")
    literal = ~masked.rlike(_META) & ~quoted
    head = (
        F.when(masked.contains("|") | quoted, "")
        .when(after.isin("?", "*", "{"), F.substring(run, F.lit(1), F.length(run) - 1))
        .otherwise(run)
    )
    # Runs of word characters do not decide whether a pattern of plain operators compiles,
    # so such patterns are checked once per shape instead of once per rule.
    simple = masked.rlike("^[A-Za-z0-9_\\-.*+?()|^$\u0001]*$") & ~masked.contains("(?")
    shape = F.when(simple, F.regexp_replace(masked, "[A-Za-z0-9_\\-\u0001]+", "a"))
    plain = F.translate(fold(F.when(literal, masked).otherwise(head)), _ESCAPED_DOT, ".")
    return rules.withColumns(
        {
            "_shape": F.coalesce(shape, regex),
            "kind": F.when(literal, "literal")
            .when(F.length(head) > 0, "head")
            .otherwise("open"),
            "match_key": F.when(literal, plain).otherwise(
                F.substring(plain, 1, MAX_HEAD)
            ),
        }
    )


def _template_ok(template: Column, names: Column, n_groups: Column) -> Column:
    """Every group the template names exists; otherwise the template is kept as text."""
    named = r"\$\{([a-zA-Z][a-zA-Z0-9]*)\}"
    bare = F.regexp_replace(template, r"\\.", "")
    names_exist = F.forall(
        F.regexp_extract_all(bare, F.lit(named), 1), lambda n: F.array_contains(names, n)
    )
    rest = F.regexp_replace(bare, named, "")
    digits = F.concat(F.lit(r"\$(?![0-"), F.least(n_groups, F.lit(9)).cast("string"), F.lit("])"))
    return names_exist & ~rest.endswith("\\") & ~F.regexp_like(rest, digits)


def _compiled(spark: SparkSession, pattern: str):
    """The compiled pattern; None where the syntax is wrong. Any other error is raised."""
    try:
        return spark._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:  # what a PatternSyntaxException is, and all it can be here
        return None


def _group_names(spark: SparkSession, pattern: str) -> list[str]:
    """Names of groups, each confirmed by a reference to it. Quoted text may hide one, so a
    pattern with ``\\Q`` is taken to have none, and its templates with names stay text."""
    if "\\Q" in pattern:
        return []
    found = sorted(set(re.findall(r"\(\?<([a-zA-Z][a-zA-Z0-9]*)>", pattern)))
    return [n for n in found if _compiled(spark, rf"(?:{pattern})\k<{n}>") is not None]


_FACTS = "good BOOLEAN, n_groups INT, names ARRAY<STRING>"


def _shape_facts(spark: SparkSession, shapes) -> list[tuple]:
    """(_shape, good, n_groups, names) of each distinct shape, from the compiled pattern."""
    rows = []
    for shape in shapes:
        pattern = _compiled(spark, shape)
        groups = pattern.matcher("").groupCount() if pattern is not None else 0
        rows.append((shape, pattern is not None, groups, _group_names(spark, shape) if pattern is not None else []))
    return rows


def _constant(facts: list[tuple]) -> Column:
    """The facts of a row's shape, looked up in a constant: no job for a small rule set."""
    if not facts:
        return F.lit(None).cast(f"STRUCT<{_FACTS}>")
    rows = []
    for shape, good, n_groups, names in facts:
        texts = F.array(*map(F.lit, names)).cast("array<string>")
        rows += [F.lit(shape), F.struct(F.lit(good).alias("good"), F.lit(n_groups).alias("n_groups"), texts.alias("names"))]
    return F.create_map(*rows)[F.col("_shape")]


def compile_rules(rules: DataFrame, max_inline: int = INLINE_RULES, memory: str | None = None) -> CompiledRules:
    """Check the patterns, drop the ones that do not compile, and choose a strategy.

    Up to ``max_inline`` rules become constants of the plan; a BIGINT has bits for 63. Entries
    with a null value are no entries. Among rules of equal creation time the greater id is
    newer; a null time or id is the oldest. With a folder as ``memory`` what is compiled of a larger
    rule set is kept there, and a later call compiles only the patterns that are new to it.
    """
    if not 0 <= max_inline <= 63:
        raise ValueError("max_inline must be from 0 to 63")
    spark = rules.sparkSession
    shaped = _with_shape(rules.filter(F.col("regex").isNotNull() & F.col("context").isNotNull()))
    instants = ("creation_time", "valid_from", "valid_until")
    first = shaped.limit(max_inline + 1).collect()
    if len(first) <= max_inline:
        facts = _shape_facts(spark, sorted({r._shape for r in first if r.kind != "literal"}))
        good, rejected = _checked(shaped.withColumn("_facts", _constant(facts)))
        rows = good.withColumns({c: F.unix_micros(c) for c in instants}).collect()
        rows.sort(key=_age)
        bounds = {t for r in rows for t in (r.valid_from, r.valid_until)}
        return CompiledRules(good, rejected, tuple(rows), tuple(sorted(bounds)))
    return _joined(spark, shaped, memory)


def _age(rule) -> tuple:
    """The order of a ``max_by`` over (creation_time, rule_id): nulls first."""
    at, rule_id = rule.creation_time, rule.rule_id
    return at is not None, at or 0, rule_id is not None, rule_id or ""


def _checked(shaped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules with the columns matching needs, rejected ones). A literal always compiles."""
    is_good = (F.col("kind") == "literal") | F.coalesce("_facts.good", F.lit(False))
    names = F.coalesce("_facts.names", F.array().cast("array<string>"))
    n_groups = F.coalesce("_facts.n_groups", F.lit(0))
    regex = F.col("regex")
    good = shaped.filter(is_good).select(
        "rule_id",
        "creation_time",
        F.coalesce("valid_from", F.lit(EARLIEST).cast("timestamp")).alias("valid_from"),
        F.coalesce("valid_until", F.lit(LATEST).cast("timestamp")).alias("valid_until"),
        "entity_type",
        F.concat(F.lit("(?i)"), regex).alias("find_rx"),
        F.concat(F.lit(r"(?i)\A(?:"), regex, F.lit(r")\z")).alias("full_rx"),
        F.transform(
            F.filter(F.map_entries("context"), lambda e: e["value"].isNotNull()),
            lambda e: F.struct(
                e["key"].alias("key"),
                e["value"].alias("value"),
                _template_ok(e["value"], names, n_groups).alias("ok"),
            ),
        ).alias("entries"),
        "kind",
        "match_key",
        *(c for c in ("factors", "rule_row") if c in shaped.columns),
    )
    return good, shaped.filter(~is_good).select("rule_id", "regex")


SHAPES_AT_ONCE = 4096  # shapes that the driver compiles before it writes their facts


def _facts_table(spark: SparkSession, shapes: DataFrame) -> DataFrame:
    """The facts of each shape. Compiled by the driver's JVM, a bounded batch at a time, each written."""
    batch, parts = [], []

    def close() -> None:
        facts = _shape_facts(spark, batch)
        parts.append(written(spark.createDataFrame(facts, f"_shape STRING, {_FACTS}"), "shapes"))
        batch.clear()

    for row in shapes.toLocalIterator():
        batch.append(row._shape)
        if len(batch) == SHAPES_AT_ONCE:
            close()
    if batch or not parts:
        close()
    return functools.reduce(DataFrame.unionByName, parts)


def _few_patterns(rules: DataFrame) -> tuple[tuple[str, str], ...] | None:
    """Distinct (entity type, pattern) of rules; None if there are too many for constants."""
    found = rules.select("entity_type", "full_rx").distinct().limit(INLINE_PATTERNS + 1).collect()
    return tuple(sorted((r.entity_type, r.full_rx) for r in found)) if len(found) <= INLINE_PATTERNS else None


def remembered(wanted: DataFrame, compute: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """``compute`` of the values of the one column of ``wanted``, kept in ``path``: only new ones are computed.

    A value always gives the same row, so that rows a repeated run has written twice are one.
    """
    spark, (key,) = wanted.sparkSession, wanted.columns
    try:
        known = spark.read.schema(wanted.schema).parquet(path)
        first, new = False, wanted.join(known, key, "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        first, new = True, wanted
    new = written(new, "new")  # apart from the folder that it is appended to
    rows = compute(new)
    if first or not new.isEmpty():
        rows.write.mode("append").parquet(path)
    return spark.read.schema(rows.schema).parquet(path).dropDuplicates([key])


def _joined(spark: SparkSession, shaped: DataFrame, memory: str | None = None) -> CompiledRules:
    # one snapshot: counts and rows belong together, and a row keeps its number
    shaped = shaped.withColumn("rule_row", F.monotonically_increasing_id())
    read_off = lambda found: found.withColumn("factors", factors_column(F.col("regex")))
    if memory is None:
        factors = F.when(F.col("kind") == "open", factors_column(F.col("regex")))
        shaped = written(shaped.withColumn("factors", factors), "rules")
    else:
        shaped = written(shaped, "rules")
        patterns = shaped.filter(F.col("kind") == "open").select("regex").distinct()
        known = remembered(patterns, read_off, f"{memory}/factors").withColumn("kind", F.lit("open"))
        shaped = shaped.join(known, ["regex", "kind"], "left")
    shapes = shaped.filter(F.col("kind") != "literal").select("_shape").distinct()
    compiled = lambda found: _facts_table(spark, found)
    facts = compiled(shapes) if memory is None else remembered(shapes, compiled, f"{memory}/shapes")
    looked_up = facts.select("_shape", F.struct("good", "n_groups", "names").alias("_facts"))
    good, rejected = _checked(shaped.join(looked_up, "_shape", "left"))
    head_len = F.when(F.col("kind") == "head", F.length("match_key"))
    is_open, has_text = F.col("kind") == "open", F.size("factors") > 0
    summary = good.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("kind") == "literal").alias("n_literal"),
        F.count_if(is_open).alias("n_open"),
        F.count_if(is_open & ~has_text).alias("n_wild"),
        F.array_sort(F.collect_set(head_len)).alias("head_lengths"),
        F.array_sort(F.collect_set("entity_type")).alias("types"),
    ).first()
    open_patterns = _few_patterns(good.filter(is_open)) if summary.n_open <= INLINE_PATTERNS else None
    wild_patterns = None
    if open_patterns is None and summary.n_wild:
        wild_patterns = _few_patterns(good.filter(is_open & ~has_text))
    bounds = (
        good.select(F.explode(F.array("valid_from", "valid_until")).alias("b"))
        .distinct()
        .limit(MAX_BOUNDARIES + 1)
        .select(F.unix_micros("b").alias("b"))
        .collect()
    )
    return CompiledRules(
        rules=good,
        rejected=rejected,
        inline=None,
        boundaries=tuple(sorted(r.b for r in bounds)) if len(bounds) <= MAX_BOUNDARIES else None,
        head_lengths=tuple(summary.head_lengths),
        n_literal=summary.n_literal,
        n_open=summary.n_open,
        types=tuple(summary.types),
        open_patterns=open_patterns,
        n_wild=summary.n_wild,
        wild_patterns=wild_patterns,
        crowds=_crowds(good) if summary.n > CROWD else (),
    )


def _crowds(rules: DataFrame) -> tuple[tuple[str, str, str, int], ...]:
    """Texts and patterns that over CROWD rules share; there are at most as many as rules over CROWD."""
    by = F.when(F.col("kind") == "open", "full_rx").otherwise("match_key").alias("by")
    shared = F.when(F.col("kind") == "open", F.col("full_rx")).otherwise(F.col("match_key")).alias("shared")
    found = rules.groupBy(by, "kind", shared, "entity_type").count().filter(F.col("count") > CROWD).collect()
    slots: dict[tuple, int] = {}
    for r in found:
        slots[r.by, r.shared, r.entity_type] = max(slots.get((r.by, r.shared, r.entity_type), 0), -(-r["count"] // CROWD))
    return tuple((*key, n) for key, n in sorted(slots.items()))


def _meet(names: DataFrame, rules: DataFrame, by: str, compiled: CompiledRules) -> DataFrame:
    """An equi-join on entity type and ``by``. Rules that crowd one key are dealt out over slots of it, each of
    which the names of that key visit, and there are as many partitions as slots."""
    crowds = [c[1:] for c in compiled.crowds if c[0] == by]
    if not crowds:
        return names.join(rules, ["entity_type", by])
    known = F.broadcast(names.sparkSession.createDataFrame(crowds, f"{by} STRING, entity_type STRING, _slots INT"))
    slots, key = F.coalesce("_slots", F.lit(1)), ["entity_type", by]
    visits = names.join(known, key, "left").withColumn("_slot", F.explode(F.sequence(F.lit(0), slots - 1))).drop("_slots")
    dealt = rules.join(known, key, "left").withColumn("_slot", F.pmod(F.xxhash64("rule_row"), slots).cast("int")).drop("_slots")
    parts = sum(c[-1] for c in crowds) + int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return visits.join(dealt.repartition(parts, *key, "_slot"), [*key, "_slot"]).drop("_slot")


def validity_slot(moment: Column, compiled: CompiledRules) -> Column:
    """The last validity boundary at or before ``moment``.

    Every rule treats two moments with the same slot alike, so rows can be summed per slot
    before they are labelled. With too many boundaries the moment itself is a (finer) slot.
    """
    if compiled.boundaries is None:
        return moment
    at, slot = F.unix_micros(moment), F
    for b in reversed(compiled.boundaries or (_OPEN_LOW,)):
        slot = slot.when(at >= b, F.lit(b))
    return F.timestamp_micros(slot)


def _covers(at: Column, rule) -> Column:
    """Whether ``at`` is in the half-open validity range of a collected rule."""
    t, cond = F.unix_micros(at), F.lit(True)
    if rule.valid_from > _OPEN_LOW:
        cond = cond & (t >= rule.valid_from)
    return cond & (t < rule.valid_until) if rule.valid_until < _OPEN_HIGH else cond


def context_column(hits: Column, name: Column, compiled: CompiledRules) -> Column:
    """The context map from the match bits of the inline rules: per key the newest match.

    Bits in a number, because the optimizer would copy the elements of an array, and with
    them the pattern tests, into every use.
    """
    by_key: dict[str, list[Column]] = {}
    for i, rule in reversed(list(enumerate(compiled.inline))):
        for e in rule.entries:
            filled = F.regexp_replace(name, rule.find_rx, F.lit(e.value)) if e.ok else F.lit(e.value)
            is_hit = hits.bitwiseAND(F.lit(1 << i).cast("bigint")) != 0
            by_key.setdefault(e.key, []).append(F.when(is_hit, filled))
    if not by_key:
        return empty_map()
    found = F.array(
        *[
            F.struct(F.lit(k).alias("key"), F.coalesce(*by_key[k]).alias("value"))
            for k in sorted(by_key)
        ]
    )
    return F.map_from_entries(F.filter(found, lambda e: e["value"].isNotNull()))


def _inline_columns(compiled: CompiledRules, at: str) -> tuple[Column, Column]:
    """(match bits, context). They name columns only, so they serve any DataFrame, and making
    them takes longer than most plans do."""
    name, kind = F.col("name"), F.col("entity_type")
    bits = [
        F.when(
            (kind == r.entity_type) & _covers(F.col(at), r) & name.rlike(r.full_rx),
            F.lit(1 << i).cast("bigint"),
        ).otherwise(F.lit(0).cast("bigint"))
        for i, r in enumerate(compiled.inline)
    ]
    return functools.reduce(Column.bitwiseOR, bits), context_column(F.col("_hits"), name, compiled)


def _label_inline(metrics: DataFrame, compiled: CompiledRules, at: str) -> DataFrame:
    if not compiled.inline:
        return metrics.withColumn("context", empty_map())
    hits, context = _inline_columns(compiled, at)
    kept = [c for c in metrics.columns if c != "context"]
    return compute_once(metrics.withColumn("_hits", hits), {"context": context}, kept)


def match_rules(names: DataFrame, compiled: CompiledRules) -> DataFrame:
    """(entity_type, name) x rules that match it by type and full, case-insensitive regex."""
    names = names.select("entity_type", "name").filter(F.col("entity_type").isin(*compiled.types)).distinct()
    parts = []
    if compiled.n_literal:
        rules = compiled.rules.filter(F.col("kind") == "literal")
        keyed = names.withColumn("match_key", fold(F.col("name")))
        parts.append(_meet(keyed, rules, "match_key", compiled))
    if compiled.head_lengths:
        rules = compiled.rules.filter(F.col("kind") == "head")
        folded = fold(F.col("name"))
        lengths = F.filter(
            F.array(*[F.lit(n) for n in compiled.head_lengths]), lambda n: n <= F.length(folded)
        )
        keyed = names.withColumn(
            "match_key", F.explode(F.transform(lengths, lambda n: F.substring(folded, F.lit(1), n)))
        )
        joined = _meet(keyed, rules, "match_key", compiled)
        parts.append(joined.filter(F.regexp_like(F.col("name"), F.col("full_rx"))))
    if compiled.n_open:
        parts.append(_match_open(names, compiled))
    if not parts:
        return names.join(compiled.rules.filter(F.lit(False)), "entity_type").select(*_MATCH)
    return functools.reduce(DataFrame.unionByName, [p.select(*_MATCH) for p in parts])


_MATCH = (
    "entity_type", "name", "rule_id", "creation_time", "valid_from", "valid_until",
    "find_rx", "entries",
)


def _match_open(names: DataFrame, compiled: CompiledRules) -> DataFrame:
    rules = compiled.rules.filter(F.col("kind") == "open")
    if compiled.open_patterns is not None:
        return _match_constants(names, rules, compiled.open_patterns, compiled)
    has_text = F.size("factors") > 0
    with_text = rules.filter(has_text)
    found = candidate_names(names, with_text, "rule_row", fold(F.col("name")))
    parts = [found.join(with_text, ["entity_type", "rule_row"]).filter(F.regexp_like(F.col("name"), F.col("full_rx")))]
    if compiled.n_wild:
        wild = rules.filter(~has_text)
        if compiled.wild_patterns is not None:
            parts.append(_match_constants(names, wild, compiled.wild_patterns, compiled))
        else:
            parts.append(_match_blocks(names, wild, compiled.n_wild))
    return functools.reduce(DataFrame.unionByName, [p.select(*_MATCH) for p in parts])


def _match_constants(
    names: DataFrame, rules: DataFrame, patterns: tuple[tuple[str, str], ...], compiled: CompiledRules
) -> DataFrame:
    hits = F.array(
        *[
            F.when((F.col("entity_type") == kind) & F.col("name").rlike(rx), F.lit(rx))
            for kind, rx in patterns
        ]
    )
    # outer: no filter that would test every pattern once more below
    hit = names.withColumn("full_rx", F.explode_outer(F.array_compact(hits)))
    # at most INLINE_PATTERNS distinct patterns were counted
    return _meet(hit.filter(F.col("full_rx").isNotNull()), rules, "full_rx", compiled)


def _match_blocks(names: DataFrame, rules: DataFrame, n_rules: int) -> DataFrame:
    """Rules that nothing but the pattern itself can tell from a name's text: each is tested on each name.

    Blocks of bounded size on the rule side, slices on the name side: each task gets one
    slice of names and one block of rules, whatever their total numbers.
    """
    blocks = -(-n_rules // BLOCK_RULES)
    rules = rules.withColumn("_block", F.pmod(F.xxhash64("rule_row"), F.lit(blocks))).withColumn(
        "_slice", F.explode(F.sequence(F.lit(0), F.lit(NAME_SALTS - 1)))
    )
    sliced = names.withColumn(
        "_slice", F.pmod(F.xxhash64("entity_type", "name"), F.lit(NAME_SALTS)).cast("int")
    ).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    joined = sliced.join(rules.hint("shuffle_hash"), ["_block", "_slice", "entity_type"])
    return joined.filter(F.regexp_like(F.col("name"), F.col("full_rx")))


def expand_templates(matches: DataFrame, outer: bool = False) -> DataFrame:
    """One row per context entry, with capture groups filled in from the entity name.

    With ``outer`` a rule without entries is one row without a key.
    The inner guard keeps a template that names a missing group away from the replace call.
    """
    e = F.col("_e")
    filled = F.regexp_replace(
        F.col("name"), F.col("find_rx"), F.when(e["ok"], e["value"]).otherwise("")
    )
    # A pattern such as ``.*`` also finds the empty rest of the name, so even plain text
    # goes through the replace.
    value = F.when(e["ok"], filled).otherwise(e["value"])
    kept = [c for c in matches.columns if c not in ("entries", "find_rx")]
    return matches.withColumn("_e", (F.explode_outer if outer else F.explode)("entries")).select(
        *kept, e["key"].alias("key"), value.alias("value")
    )


def _tree_nodes(low: Column, high: Column) -> Column:
    """Nodes (level, place) of a binary tree whose leaves are exactly low to high - 1; two a level at most."""
    levels = F.sequence(F.lit(0), F.greatest(F.floor(F.log2(F.greatest(high, F.lit(1)))), F.lit(0)).cast("int"))

    def at(level: Column) -> Column:
        size = F.pow(F.lit(2.0), level)
        first, last = F.ceil(low / size), F.floor(high / size)
        node = lambda place, taken: F.when((first < last) & taken, F.struct(level.alias("level"), place.cast("bigint").alias("place")))
        return F.array(node(first, first % 2 == 1), node(last - 1, last % 2 == 1))

    return F.array_compact(F.flatten(F.transform(levels, at)))


def _tree_path(leaf: Column, leaves: Column) -> Column:
    """A leaf and all nodes above it that a range within ``leaves`` may use."""
    levels = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(leaves, F.lit(1)))).cast("int"))
    return F.transform(levels, lambda level: F.struct(level.alias("level"), F.floor(leaf / F.pow(F.lit(2.0), level)).cast("bigint").alias("place")))


def context_segments(names: DataFrame, compiled: CompiledRules) -> DataFrame:
    """(entity_type, name, seg_from, seg_until, context): disjoint validity ranges per entity.

    Rows grow with n log n in the n rules of an entity: ranges of rules never meet ranges between
    instants directly. A node keeps only the newest rule of a key.
    """
    matches = match_rules(names, compiled)
    entity = ["entity_type", "name"]
    newest = F.struct("creation_time", "rule_id")
    if compiled.always_valid:
        pieces = expand_templates(matches).withColumnsRenamed({"valid_from": "seg_from", "valid_until": "seg_until"})
        winners = pieces.groupBy(*entity, "seg_from", "seg_until", "key").agg(F.max_by("value", newest).alias("value"))
    else:
        winners = _winners_by_tree(matches, entity, newest, compiled.boundaries is None)
    return winners.groupBy(*entity, "seg_from", "seg_until").agg(
        sorted_map(F.map_from_entries(F.collect_list(F.struct("key", "value")))).alias("context")
    )


def _numbered(instants: DataFrame, entity: list[str]) -> DataFrame:
    """Distinct (entity, at) with their number, the next instant and the count of the entity's.

    A day is numbered on its own, after the counts of the days before it.
    """
    instants = instants.withColumn("_day", F.date_trunc("day", "at"))
    whole, day = Window.partitionBy(*entity), Window.partitionBy(*entity, "_day").orderBy("at")
    days = instants.groupBy(*entity, "_day").agg(F.count("*").alias("n"), F.min("at").alias("first")).select(
        *entity,
        "_day",
        F.coalesce(F.sum("n").over(whole.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.lead("first").over(whole.orderBy("_day")).alias("next"),
        F.sum("n").over(whole).alias("leaves"),
    )
    return instants.join(days, [*entity, "_day"]).select(
        *entity,
        "at",
        (F.col("before") + F.row_number().over(day) - 1).alias("number"),
        F.coalesce(F.lead("at").over(day), "next").alias("until"),
        "leaves",
    )


def _winners_by_tree(matches: DataFrame, entity: list[str], newest: Column, many: bool) -> DataFrame:
    """(entity, seg_from, seg_until, key, value): of each key the newest rule between two instants.

    Of rules of one range only the newest counts, so they are written as one row a key. ``many``
    is for instants that are too many for one window of an entity.
    """
    span = [*entity, "valid_from", "valid_until"]
    entries = written(
        expand_templates(matches, outer=True).groupBy(*span, "key").agg(F.max_by("value", newest).alias("value"), F.max(newest).alias("age")),
        "entries",
    )
    ends = entries.select(*span).distinct().select(*span, F.posexplode(F.array("valid_from", "valid_until")).alias("side", "at"))
    if many:
        instants = _numbered(ends.select(*entity, "at").distinct(), entity)
    else:
        numbered = Window.partitionBy(*entity).orderBy("at")
        instants = ends.select(*entity, "at").distinct().withColumns(
            {"number": F.row_number().over(numbered) - 1, "until": F.lead("at").over(numbered), "leaves": F.count("*").over(Window.partitionBy(*entity))}
        )
    ends = ends.join(instants.select(*entity, "at", "number"), [*entity, "at"])
    ranges = ends.groupBy(*span).agg(
        F.max(F.when(F.col("side") == 0, F.col("number"))).alias("low"),
        F.max(F.when(F.col("side") == 1, F.col("number"))).alias("high"),
    )
    nodes = (
        entries.filter(F.col("key").isNotNull()).join(ranges, span)
        .select(*entity, "key", "value", "age", F.explode(_tree_nodes(F.col("low"), F.col("high"))).alias("node"))
        .groupBy(*entity, "node", "key")
        .agg(F.max_by("value", "age").alias("value"), F.max("age").alias("age"))
    )
    leaves = instants.filter(F.col("until").isNotNull()).select(
        *entity, F.col("at").alias("seg_from"), F.col("until").alias("seg_until"), F.explode(_tree_path(F.col("number"), F.col("leaves"))).alias("node")
    )
    return leaves.join(nodes, [*entity, "node"]).groupBy(*entity, "seg_from", "seg_until", "key").agg(F.max_by("value", "age").alias("value"))


SPREAD = 1024  # join keys over which rows that can't match are spread


def enrich(
    metrics: DataFrame,
    segments: DataFrame,
    at: str = "timestamp",
    context: str = "context",
    types: Sequence[str] | None = None,
    many: bool = False,
) -> DataFrame:
    """Attach the context valid at column ``at``. At most one segment covers an instant, so
    the row count stays the same; entities without a match get an empty map.

    Entities whose type is not in ``types`` have no segments. One of them may hold a third of
    all rows, so they are spread over keys that match nothing. ``many`` is for entities with
    more than a few hundred segments: rows then meet them by an as-of merge in slices of time.
    """
    if many:
        known = segments.withColumnRenamed("context", "_context")
        found = as_of(metrics.drop(context), known, ["entity_type", "name"], at, "seg_from", ["seg_until", "_context"])
        inside = F.col(at) < F.col("seg_until")
        return found.withColumn(context, F.coalesce(F.when(inside, F.col("_context")), empty_map())).drop("seg_until", "_context")
    seg = segments.select(
        F.col("entity_type").alias("_type"),
        F.col("name").alias("_name"),
        "seg_from",
        "seg_until",
        F.col("context").alias("_context"),
    )
    covers = (F.col(at) >= F.col("seg_from")) & (F.col(at) < F.col("seg_until"))
    metrics = metrics.drop(context)
    by_type, by_name = F.col("entity_type"), F.col("name")
    if types is not None:
        plain = [c for c, t in metrics.dtypes if "map<" not in t]  # maps have no hash
        slot = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(*plain), F.lit(SPREAD)))
        covered = by_type.isin(*types)
        by_type, by_name = F.when(covered, by_type).otherwise(""), F.when(covered, by_name).otherwise(slot)
    keyed = metrics.withColumns({"_by_type": by_type, "_by_name": by_name})
    joined = keyed.join(
        seg, (F.col("_by_type") == F.col("_type")) & (F.col("_by_name") == F.col("_name")) & covers, "left"
    )
    return joined.withColumn(context, F.coalesce("_context", empty_map())).drop(*seg.columns, "_by_type", "_by_name")


def label(
    metrics: DataFrame,
    compiled: CompiledRules,
    at: str = "timestamp",
    names: DataFrame | None = None,
) -> DataFrame:
    """Attach the context each row's entity has at ``at``.

    ``names`` may give the entities of ``metrics`` where they are cheaper to come by.
    """
    if compiled.inline is not None:
        return _label_inline(metrics, compiled, at)
    segments = context_segments(metrics if names is None else names, compiled)
    return enrich(metrics, segments, at, types=compiled.types, many=compiled.boundaries is None)


def probe_context(strings: DataFrame, compiled: CompiledRules, at: Column) -> DataFrame:
    """The context each string would get as a topic and as a principal: always two rows."""
    probes = strings.select(
        F.explode(F.array(F.lit("TOPIC"), F.lit("PRINCIPAL"))).alias("entity_type"),
        F.col(strings.columns[0]).alias("name"),
        at.alias("timestamp"),
    )
    return label(probes, compiled).select("name", "entity_type", "context")


def list_rules(changelog: DataFrame, version: str = "version") -> DataFrame:
    """Current rules; a null regex is a tombstone."""
    return latest_by_key(changelog, ["rule_id"], [version], F.col("regex").isNull())


def list_prices(changelog: DataFrame, version: str = "version") -> DataFrame:
    """Current price rules; a null factor is a tombstone."""
    return latest_by_key(changelog, ["metric_name"], [version], F.col("cost_factor").isNull())
