"""Helpers for the open string maps (context, tags)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def empty_map() -> Column:
    return F.create_map().cast("map<string,string>")


def literal_map(entries: Mapping[str, str]) -> Column:
    if not entries:
        return empty_map()
    return F.create_map(*[F.lit(x) for kv in entries.items() for x in kv])


def sorted_map(m: Column) -> Column:
    return F.map_from_entries(F.sort_array(F.map_entries(m)))


def canonical_json(m: Column) -> Column:
    """Key-sorted JSON text: equal maps give equal text, so it can be a grouping key."""
    return F.to_json(sorted_map(m))


def json_to_map(text: Column) -> Column:
    return F.from_json(text, "map<string,string>")


def put(m: Column, key: str | Column, value: Column) -> Column:
    """Copy of ``m`` with ``key`` set; the old entry goes first because maps reject duplicates."""
    k = F.lit(key) if isinstance(key, str) else key
    return F.map_concat(F.map_filter(m, lambda a, _: a != k), F.create_map(k, value))


def pick(m: Column, keys) -> Column:
    return F.map_filter(m, lambda k, _: k.isin(list(keys)))


def explode_non_null(df: DataFrame, array: Column, alias: str, keep=()) -> DataFrame:
    """One row per non-null element.

    A plain explode lets the optimizer derive a "has elements" filter and push it, with the
    whole expression behind ``array``, down to the scan. The outer form does not.
    """
    return df.select(*keep, F.explode_outer(array).alias(alias)).filter(F.col(alias).isNotNull())


def compute_once(df: DataFrame, columns: Mapping[str, Column], keep=()) -> DataFrame:
    """``keep`` plus the given columns, each evaluated once per row.

    A filter on a projected column is pushed below the projection with a copy of its
    expression, so that JSON would be parsed and patterns tested again for every condition.
    A filter does not pass a generator.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*keep, F.inline_outer(F.array(row)))
