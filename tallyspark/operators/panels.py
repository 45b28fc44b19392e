"""Chart and dashboard shapes over history rows (time, name, value) and gauges."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.config import duration_seconds
from tallyspark.functions.buckets import instant, range_or_default
from tallyspark.functions.maps import canonical_json
from tallyspark.operators.asof import as_of
from tallyspark.operators.shares import with_group_total
from tallyspark.session import written

UNKNOWN_PRINCIPAL = "unknown"


def panel_range(start: datetime | None = None, end: datetime | None = None):
    """The range of a panel: open bounds mean the last seven days."""
    return range_or_default(start, end, 7)


def series_matrix(hist: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """One row per time, one column per series; absent or 0 is null.

    Naming the series saves the extra job that finds them.
    """
    pivoted = hist.groupBy("time").pivot("name", list(names) if names else None).sum("value")
    series = [c for c in pivoted.columns if c != "time"]
    return pivoted.select("time", *[F.nullif(F.col(f"`{c}`"), F.lit(0.0)).alias(c) for c in series])


def normalize_series(hist: DataFrame) -> DataFrame:
    """Each value as percent of the sum of its time; zeros stay out."""
    shown = hist.filter(F.col("value").isNotNull() & (F.col("value") != 0))
    return with_group_total(shown, ["time"], "value").select(
        "time", "name", F.try_divide(F.col("value"), F.col("group_total")).alias("_s")
    ).select("time", "name", (F.col("_s") * 100).alias("percent"))


def series_csv(hist: DataFrame) -> DataFrame:
    """Sorted CSV lines ``time,name,value``."""
    line = F.concat_ws(
        ",", F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "name", F.col("value").cast("string")
    )
    return hist.select(line.alias("line")).orderBy("line")


def series_totals(hist: DataFrame) -> DataFrame:
    return hist.groupBy("name").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"))


def panel_by(
    gauges: DataFrame,
    gauge: str,
    by: str,
    agg: str,
    at: datetime | None = None,
    lookback: str = "2 minutes",
    where: Column | None = None,
) -> DataFrame:
    """Largest sample of each series in the look-back, then sum or max by one label.

    ``gauges`` has (name, tags, value, event_time); the look-back is (at - lookback, at].
    Without ``at`` the whole input is the look-back.
    """
    samples = gauges.filter(F.col("name") == gauge)
    if where is not None:
        samples = samples.filter(where)
    if at is not None:
        start = F.lit(at.timestamp()) - duration_seconds(lookback)
        samples = samples.filter(
            (F.col("event_time") <= instant(at)) & (F.col("event_time") > F.timestamp_seconds(start))
        )
    label = F.coalesce(F.col("tags")[by], F.lit("")).alias(by)
    series = samples.groupBy(label, canonical_json(F.col("tags")).alias("_series")).agg(
        F.max("value").alias("value")
    )
    reduce = {"sum": F.sum, "max": F.max}[agg]
    return series.groupBy(by).agg(reduce("value").alias("value"))


def known_principal() -> Column:
    """``principal != "unknown"``; a series without the label passes."""
    return F.coalesce(F.col("tags")["principal"], F.lit("")) != UNKNOWN_PRINCIPAL


def panel_share(
    gauges: DataFrame, gauge: str, principal: str, at: datetime | None = None, lookback="2 minutes"
) -> DataFrame:
    """One principal's part of the sum over all known principals."""
    sums = panel_by(gauges, gauge, "principal", "sum", at, lookback, known_principal())
    own = F.sum(F.when(F.col("principal") == principal, F.col("value")))
    return sums.agg(F.try_divide(own, F.sum("value")).alias("share")).select(
        F.lit(principal).alias("principal"), "share"
    )


def label_values(gauges: DataFrame, key: str) -> DataFrame:
    value = F.col("tags")[key]
    return gauges.filter(value.isNotNull() & (value != "")).select(value.alias("label")).distinct()


GRID_STEPS = 1000  # steps of a series that one row of the grid unfolds into


def fill_gaps(hist: DataFrame, step: str = "1 hour", slice_width: str = "30 days") -> DataFrame:
    """Every step between the first and last time of a series; gaps repeat the value before.

    A long series is spread: its grid unfolds in runs of steps, and the values before are carried
    from slice to slice of time (:func:`as_of`). A null value is a gap. The history is aggregated
    already and used twice, so it is written first.
    """
    hist = written(hist, "history")
    each = F.expr(f"INTERVAL {step}")
    run = F.expr(f"INTERVAL {step} * {GRID_STEPS}")
    bounds = hist.groupBy("name").agg(F.min("time").alias("_lo"), F.max("time").alias("_hi"))
    runs = bounds.select("name", "_hi", F.explode(F.sequence("_lo", "_hi", run)).alias("_from")).repartition("name", "_from")
    last = F.least(F.col("_hi"), F.col("_from") + F.expr(f"INTERVAL {step} * {GRID_STEPS - 1}"))
    grid = runs.select("name", F.explode(F.sequence("_from", last, each)).alias("time"))
    known = hist.filter(F.col("value").isNotNull()).select("name", "time", "value", F.col("time").alias("_since"))
    filled = as_of(grid, known, ["name"], "time", "time", ["value", "_since"], slice_width)
    return filled.select("name", "time", "value", (F.col("_since").isNull() | (F.col("_since") < F.col("time"))).alias("is_filled"))
