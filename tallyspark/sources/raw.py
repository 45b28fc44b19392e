"""Raw metric records: JSON files or a broker topic, batch or streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.maps import compute_once
from tallyspark.functions.normalize import epoch_to_instant, parse_instant
from tallyspark.schemas import RAW_JSON

CORRUPT = "_corrupt"


def parse_raw(
    records: DataFrame,
    json_column: str = "value",
    time_unit: str = "seconds",
    event_time: Column | None = None,
    source: str | None = None,
) -> DataFrame:
    """JSON text to raw rows. Unparseable records stay, with their text in ``_corrupt``, so
    that :func:`valid_raw` and :func:`corrupt_raw` can part them.

    ``source`` names a column that says where a record came from; it becomes ``source``.
    ``event_time`` is the arrival time that windows use; without one it is the payload time.
    """
    body = F.from_json(
        F.col(json_column).cast("string"),
        f"{RAW_JSON}, {CORRUPT} STRING",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT},
    )
    arrival = {} if event_time is None else {"event_time": event_time}
    origin = {} if source is None else {"source": F.col(source)}
    parsed = compute_once(records, {"_r": body, **arrival, **origin})
    text = F.col("_r.timestamp")
    moment = F.coalesce(epoch_to_instant(text, time_unit), parse_instant(text))
    return parsed.withColumn("_at", moment).select(
        F.col("event_time" if arrival else "_at").alias("event_time"),
        F.col("_at").alias("timestamp"),
        "_r.name",
        "_r.fields",
        "_r.tags",
        f"_r.{CORRUPT}",
        *origin,
    )


def _is_valid() -> Column:
    """Whole records with a name and both instants; windows could not place any other."""
    return F.col(CORRUPT).isNull() & F.col("name").isNotNull() & F.col("event_time").isNotNull() & F.col("timestamp").isNotNull()


def valid_raw(parsed: DataFrame) -> DataFrame:
    return parsed.filter(_is_valid()).drop(CORRUPT)


def corrupt_raw(parsed: DataFrame) -> DataFrame:
    """Every record that :func:`valid_raw` leaves out."""
    return parsed.filter(~_is_valid())


def read_raw(
    spark: SparkSession,
    paths: str | Sequence[str] | None = None,
    *,
    topics: Sequence[str] = (),
    broker_options: dict | None = None,
    time_unit: str = "seconds",
    streaming: bool = False,
    corrupt: bool = False,
) -> DataFrame:
    """Raw rows of JSON-lines files (``paths``) or of broker topics (``topics``).

    With ``corrupt`` the records that are not valid instead, for a side output or a count.

    Several paths or topics form one stream. The broker source needs Spark's Kafka package;
    its record time becomes the event time.
    """
    side = corrupt_raw if corrupt else valid_raw
    reader = spark.readStream if streaming else spark.read
    if topics:
        source = reader.format("kafka").option("subscribe", ",".join(topics))
        for key, value in (broker_options or {}).items():
            source = source.option(key, value)
        return side(parse_raw(source.load(), "value", time_unit, F.col("timestamp")))
    paths = [paths] if isinstance(paths, str) else list(paths or ())
    if not paths:
        raise ValueError("read_raw needs paths or topics")
    if not streaming:
        return side(parse_raw(reader.text(paths), "value", time_unit))
    lines = reader.format("text").load(paths[0])
    for path in paths[1:]:
        lines = lines.union(spark.readStream.format("text").load(path))
    return side(parse_raw(lines, "value", time_unit))


def read_pages(spark: SparkSession, path: str, metric_name: str, group_by: str, cluster_id: str):
    """All saved pages of one vendor query, one file per page; no files means no rows."""
    try:
        pages = spark.read.text(path, wholetext=True)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        pages = spark.createDataFrame([], "value STRING")
    return pages.select(
        F.col("value").alias("body"),
        F.lit(metric_name).alias("metric_name"),
        F.lit(group_by).alias("group_by"),
        F.lit(cluster_id).alias("cluster_id"),
    )


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt out over all cores. A file with one row group, or a topic with few partitions, comes
    as few tasks, and to parse and label a row costs much more than to move it."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)
