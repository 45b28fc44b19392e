"""Text that every match of a regex contains, and an index of names by pieces of their text.

A rule such as ``.*-orders-(eu|us).*`` matches only names with "-orders-" and with "eu" or "us".
:func:`required_factors` reads such clauses off the pattern; :func:`candidate_names` joins names
and rules on short pieces of text (up to three characters) instead of testing every rule on every
name: of each rule, the clause whose rarest pieces occur in the fewest names is its join key.
"""

from __future__ import annotations

import string
import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = 3  # characters of the longest indexed piece
SALTS = 16  # parallel slices of the names that share a piece

_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
_ANY = -1  # no upper bound of a repetition


def required_factors(regex: str) -> list[list[str]]:
    """Clauses of a Java regex, ASCII letters folded: every match contains a text of each clause.

    What is not understood adds no clause, so the answer may be short of some but is never wrong.
    Quoted text (``\\Q``), flags other than ``i``, and unbalanced patterns have no clauses at all.
    """
    if "\\Q" in regex:
        return []
    try:
        clauses, end = _alternatives(regex.translate(_LOWER), regex, 0)
    except (IndexError, ValueError):
        return []
    return clauses if end == len(regex) else []


def _alternatives(text: str, raw: str, at: int) -> tuple[list[list[str]], int]:
    """Clauses of branches up to a closing bracket or the end, and where that is."""
    branches = []
    while True:
        clauses, at = _branch(text, raw, at)
        branches.append(clauses)
        if at < len(text) and text[at] == "|":
            at += 1
            continue
        break
    if len(branches) == 1:
        return branches[0], at
    if not all(branches):
        return [], at
    best = [max(b, key=lambda c: min(map(len, c))) for b in branches]
    return [sorted({t for clause in best for t in clause})], at


def _branch(text: str, raw: str, at: int) -> tuple[list[list[str]], int]:
    clauses: list[list[str]] = []
    run = ""

    def close() -> None:
        nonlocal run
        if run:
            clauses.append([run])
        run = ""

    while at < len(text) and text[at] not in "|)":
        if text[at] in "^$":
            at += 1
            continue
        literal, inner, width, at = _item(text, raw, at)
        low, high, at = _repetition(text, at)
        if width == 0:  # a look around or a border: it takes no text
            if high != 1 or low != 1:
                close()
        elif literal is not None and low == high == 1:
            run += literal
        elif literal is not None and low >= 1:
            run += literal
            close()
            run = literal
        else:
            close()
            if low >= 1:
                clauses.extend(inner)
    close()
    return clauses, at


def _item(text: str, raw: str, at: int) -> tuple[str | None, list[list[str]], int, int]:
    """(its text if it is one character, clauses if it is a group, 0 if it takes no text, what follows)."""
    c = text[at]
    if c == "[":
        end = _class_end(text, at)
        inside = text[at + 1 : end]
        plain = len(inside) == 1 and inside != "^"
        return (inside if plain else None), [], 1, end + 1
    if c == "(":
        kind, start = _group(text, raw, at)
        clauses, end = _alternatives(text, raw, start)
        if text[end] != ")":
            raise ValueError("unbalanced")
        return None, clauses if kind == "group" else [], 1 if kind == "group" else 0, end + 1
    if c == "\\":
        nxt = raw[at + 1]
        if not (nxt.isascii() and nxt.isalnum()):
            return text[at + 1], [], 1, at + 2
        if nxt in "bBAzZG":
            return None, [], 0, at + 2
        if nxt in "pPxukNc0" or nxt.isdigit():
            raise ValueError("long escape")
        return None, [], 1, at + 2
    return (None if c == "." else c), [], 1, at + 1


def _group(text: str, raw: str, at: int) -> tuple[str, int]:
    """(group or look, where its content starts)."""
    if text[at + 1] != "?":
        return "group", at + 1
    for opening, kind in (("?:", "group"), ("?>", "group"), ("?=", "look"), ("?!", "look"), ("?<=", "look"), ("?<!", "look"), ("?i:", "group")):
        if raw.startswith(opening, at + 1):
            return kind, at + 1 + len(opening)
    if raw.startswith("?<", at + 1):
        return "group", raw.index(">", at) + 1
    raise ValueError("flags")


def _class_end(text: str, at: int) -> int:
    """The bracket that closes a character class; nested classes and escapes in it are not read."""
    end = at + 1
    if text[end] == "^":
        end += 1
    if text[end] == "]":
        raise ValueError("class")
    while text[end] != "]":
        if text[end] in "[\\&":
            if text[end] != "\\" or text[end + 1] in "qe":
                raise ValueError("class")
            end += 1
        end += 1
    return end


def _repetition(text: str, at: int) -> tuple[int, int, int]:
    low = high = 1
    if at < len(text) and text[at] in "?*+":
        low, high = {"?": (0, 1), "*": (0, _ANY), "+": (1, _ANY)}[text[at]]
        at += 1
    elif at < len(text) and text[at] == "{":
        end = text.index("}", at)
        first, comma, last = text[at + 1 : end].partition(",")
        low = int(first)
        high = int(last) if last else _ANY if comma else low
        at = end + 1
    else:
        return low, high, at
    return low, high, at + 1 if at < len(text) and text[at] in "?+" else at


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this file


def factors_column(regex: Column) -> Column:
    """The clauses of a rule's regex; run once for each rule and never for a record."""
    return F.udf(required_factors, "array<array<string>>", useArrow=False)(regex)


def pieces(text: Column, sizes: tuple[int, ...] = tuple(range(1, PIECE + 1))) -> Column:
    """Distinct pieces of a text, of each size."""
    def of_size(n: int) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))
        return F.when(F.length(text) >= n, cut).otherwise(F.array().cast("array<string>"))

    every = [of_size(n) for n in sizes]
    return F.array_distinct(F.concat(*every))


def candidate_names(names: DataFrame, rules: DataFrame, key: str, folded: Column) -> DataFrame:
    """(entity_type, name, key) of every name that holds the chosen text of a rule, each pair once.

    ``names`` has entity_type and name, ``folded`` is the name as ``factors`` are folded; ``rules``
    has ``key``, entity_type and ``factors`` with one clause at least. Pieces that no rule asks for
    are not kept, and rules with a text that no name holds go at once.
    """
    clauses = rules.select(key, "entity_type", F.posexplode("factors").alias("clause", "texts"))
    texts = clauses.select(key, "entity_type", "clause", F.explode("texts").alias("text"))
    size = F.least(F.length("text"), F.lit(PIECE))
    asked = texts.withColumn(
        "piece",
        F.explode(F.transform(F.sequence(F.lit(1), F.length("text") - size + 1), lambda i: F.substring(F.col("text"), i, size))),
    )
    wanted = asked.select("entity_type", "piece").distinct()
    held = names.select("entity_type", "name", F.explode(pieces(folded)).alias("piece")).join(wanted, ["entity_type", "piece"], "left_semi")
    frequency = held.groupBy("entity_type", "piece").agg(F.count("*").alias("n"))
    rarest = (
        asked.join(frequency, ["entity_type", "piece"], "left")
        .groupBy(key, "entity_type", "clause", "text")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("least"))
    )
    chosen = (
        rarest.groupBy(key, "entity_type", "clause")
        .agg(F.sum("least.n").alias("cost"), F.collect_set("least.piece").alias("keys"))
        .groupBy(key, "entity_type")
        .agg(F.min_by("keys", F.struct("cost", "clause")).alias("keys"))
    )
    salt = F.pmod(F.xxhash64("name"), F.lit(SALTS))
    left = held.withColumn("salt", salt)
    right = chosen.select(key, "entity_type", F.explode("keys").alias("piece")).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))
    )
    return left.join(right, ["entity_type", "piece", "salt"]).select("entity_type", "name", key).distinct()
