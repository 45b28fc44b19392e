"""As-of merge by slices of time: each row gets the newest version at or before its time.

Rows and versions meet in a slice (by default a day) of their key, not on the key alone, so a key
that holds a large part of all rows is spread over its slices and, within one, over salts. What was
in force when a slice begins is carried in: versions are reduced to the last one of each slice, and
these few rows carry the value over the slices' borders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SALTS = 8  # parallel parts of the rows of a slice


def as_of(
    rows: DataFrame,
    versions: DataFrame,
    keys: Sequence[str],
    at: str,
    since: str,
    carried: Sequence[str],
    slice_width: str = "1 day",
    salts: int = SALTS,
) -> DataFrame:
    """``rows`` with the ``carried`` columns of the version of the same ``keys`` that was newest at ``at``.

    ``versions`` has ``keys``, ``since`` and ``carried``. Rows before the first version, rows whose
    key or time is null and keys without versions get nulls; every row stays, equal ones too. Of
    versions with one key and time that of the greatest xxhash64 of the carried values counts, so
    equal input gives equal output. A null in a carried column is carried as such.
    """
    names = list(rows.columns)
    hidden = {c: f"_row_{i}" for i, c in enumerate(names)}
    by = [f"_key_{i}" for i in range(len(keys))]
    left = rows.select(
        *(F.col(f"`{c}`").alias(h) for c, h in hidden.items()),
        *(F.col(f"`{k}`").alias(b) for k, b in zip(keys, by)),
        F.col(f"`{at}`").alias("_at"),
    )
    left = left.withColumn("_slice", _slice("_at", slice_width))
    plain = [h for h in left.columns if "map<" not in dict(left.dtypes)[h]]
    left = left.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int"))

    known = versions.select(
        *(F.col(f"`{k}`").alias(b) for k, b in zip(keys, by)),
        F.col(f"`{since}`").alias("_at"),
        F.struct(*(F.col(f"`{c}`") for c in carried)).alias("_value"),
    ).dropna(subset=[*by, "_at"])
    known = known.groupBy(*by, "_at").agg(F.max_by("_value", F.xxhash64(F.to_json("_value"))).alias("_value"))
    known = known.withColumn("_slice", _slice("_at", slice_width))

    # the value at the start of each slice that has rows
    last = known.groupBy(*by, "_slice").agg(F.max_by("_value", "_at").alias("_value"), F.lit(False).alias("_asked"))
    asked = left.select(*by, "_slice").distinct().withColumns({"_value": F.lit(None).cast(known.schema["_value"].dataType), "_asked": F.lit(True)})
    merged = last.unionByName(asked).groupBy(*by, "_slice").agg(F.max("_asked").alias("_asked"), F.first("_value", ignorenulls=True).alias("_value"))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = merged.withColumn("_start", F.last("_value", ignorenulls=True).over(before)).filter("_asked")
    opening = slices.filter("_start IS NOT NULL").select(*by, F.col("_slice").alias("_at"), F.col("_start").alias("_value"), "_slice", F.lit(0).alias("_kind"))
    inside = known.join(slices.select(*by, "_slice"), [*by, "_slice"], "left_semi").select(*by, "_at", "_value", "_slice", F.lit(1).alias("_kind"))
    changes = opening.unionByName(inside).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    union = left.withColumn("_kind", F.lit(2)).unionByName(changes, allowMissingColumns=True)
    so_far = Window.partitionBy(*by, "_slice", "_salt").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = union.withColumn("_found", F.last("_value", ignorenulls=True).over(so_far)).filter("_kind = 2")
    return found.select(*(F.col(h).alias(c) for c, h in hidden.items()), *(F.col("_found")[c].alias(c) for c in carried))


def _slice(at: str, width: str):
    """Start of the slice of an instant; null where that is null."""
    size = F.expr(f"timestampdiff(MICROSECOND, timestamp'2000-01-01', timestamp'2000-01-01' + INTERVAL {width})")
    micros = F.unix_micros(at)
    return F.timestamp_micros(micros - F.pmod(micros, size))
