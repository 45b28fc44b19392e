"""The stored fact table: versions of rows as plain Parquet, the newest version of a key counts."""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterable, Sequence
from datetime import date, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.buckets import instant, range_or_default
from tallyspark.functions.maps import canonical_json, json_to_map
from tallyspark.operators.latest import latest_by_key
from tallyspark.schemas import EXPORT, FACTS
from tallyspark.session import prepare

UNKNOWN_TARGET = "unknown"
WINDOW_KEY = ["start_time", "end_time", "entity_type", "initial_metric_name", "name"]
_STORED = f"{FACTS}, id_follows BOOLEAN, version BIGINT, chunk_days INT, chunk_start DATE"
CHUNK_DAYS = 7


def with_target(df: DataFrame) -> DataFrame:
    return df.withColumn("target", F.coalesce(F.col("context")["topic"], F.lit(UNKNOWN_TARGET)))


def iso_instant(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _id_of_row() -> Column:
    parts = [
        iso_instant(F.col("start_time")),
        iso_instant(F.col("end_time")),
        "initial_metric_name",
        "entity_type",
        "name",
        "tags",
        "context_json",
        "target",
    ]
    return F.sha1(F.concat(*parts))


def fact_id(df: DataFrame) -> DataFrame:
    """Row id over everything but the value, so that a re-run replaces its own rows."""
    return df.withColumn("row_id", _id_of_row())


def to_facts(windowed: DataFrame) -> DataFrame:
    """Windowed rows (context map, tags text) to the stored shape."""
    df = windowed
    if "cost" not in df.columns:
        df = df.withColumn("cost", F.lit(None).cast("double"))
    if "context_json" not in df.columns:
        df = df.withColumn("context_json", canonical_json(F.col("context")))
    return fact_id(with_target(df)).select(*_names(FACTS))


def to_table_friendly(windowed: DataFrame) -> DataFrame:
    """Same columns with both maps as JSON text."""
    tags = F.col("tags")
    if dict(windowed.dtypes)["tags"] != "string":
        tags = canonical_json(tags)
    return windowed.select(
        "start_time",
        "end_time",
        "initial_metric_name",
        "entity_type",
        "name",
        "value",
        "cost",
        tags.alias("tags"),
        canonical_json(F.col("context")).alias("context"),
    )


def windowed_records(windowed: DataFrame) -> DataFrame:
    """(key, value) JSON records of the result stream; the key leaves the context out.

    Ready for ``write.format("kafka")`` where that package is installed, or for any file sink.
    """
    fields = ["startTime", "endTime", "entityType", "initialMetricName", "name"]
    columns = [F.col(c).alias(f) for c, f in zip(WINDOW_KEY, fields)]
    key = F.struct(*columns)
    value = F.struct(*columns, "value", "cost", "tags", "context")
    return windowed.select(F.to_json(key).alias("key"), F.to_json(value).alias("value"))


def write_windowed(windowed: DataFrame, path: str, mode: str = "append") -> None:
    windowed_records(windowed).write.mode(mode).parquet(path)


def olap_view(facts: DataFrame) -> DataFrame:
    """The exchange shape: no cost, maps as text."""
    return facts.select(
        "start_time",
        "end_time",
        "initial_metric_name",
        "entity_type",
        "name",
        "tags",
        F.col("context_json").alias("context"),
        "value",
        "target",
        F.col("row_id").alias("id"),
    )


def from_olap_view(rows: DataFrame) -> DataFrame:
    context = json_to_map(F.col("context"))
    rebuilt = {
        "context": context,
        "context_json": canonical_json(context),
        "cost": F.lit(None).cast("double"),
        "row_id": F.col("id"),
        "name": F.coalesce("name", F.lit("")),  # CSV reads an empty text as null
    }
    return rows.select(*[rebuilt.get(c, F.col(c)).alias(c) for c in _names(FACTS)])


def _names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.replace("MAP<STRING, STRING>", "MAP").split(",")]


def contained(start: datetime | None, end: datetime | None) -> Column:
    """Rows whose window lies inside [start, end]; an open bound adds no condition."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col("start_time") >= instant(start))
    if end is not None:
        cond = cond & (F.col("end_time") <= instant(end))
    return cond


def latest_by_window_key(versions: DataFrame, version: str = "version") -> DataFrame:
    """The relational sink's view: context is not in the key, the last writer wins."""
    return latest_by_key(versions, WINDOW_KEY, [version])


def latest_by_row_id(versions: DataFrame, version: str = "version") -> DataFrame:
    short = _short_id()
    keyed = versions.withColumns(short).drop("row_id")
    return latest_by_key(keyed, list(short), [version]).withColumn("row_id", _whole_id()).select(*versions.columns)


def chunk_start(moment: Column, days: int) -> Column:
    """First day of the chunk of ``days`` days that holds ``moment``, counted from 1970-01-01."""
    day = F.unix_date(F.to_date(moment))
    return F.date_from_unix_date(day - F.pmod(day, F.lit(days)))


def with_chunk(facts: DataFrame, days: int) -> DataFrame:
    """Adds the chunk of each row. The width goes along, so that readers need not be told."""
    return facts.withColumns({"chunk_days": F.lit(days), "chunk_start": chunk_start(F.col("start_time"), days)})


class FactTable:
    """Upsert by key on Parquet folders: by row id, or with ``key=WINDOW_KEY`` by window key.

    Each upsert is one folder ``version=N`` with a folder for each chunk of days; writing a version
    again replaces its folder, so a replayed micro-batch changes nothing. Readers take the newest
    version of a chunk as it is, and of older ones, by an anti-join, the rows that no later version
    replaces. Compaction and retention write their result as a table in a fresh folder, and the caller
    decides when to read from there.
    """

    def __init__(self, spark: SparkSession, path: str, chunk_days: int = CHUNK_DAYS, key: Sequence[str] = ("row_id",)):
        self.spark, self.path = spark, path.rstrip("/")
        self.chunk_days, self.key = chunk_days, list(key)

    def versions(self, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
        """All versions of the rows in a range, which prunes chunk folders and row groups."""
        prepare(self.spark)
        try:
            rows = self.spark.read.schema(_STORED).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], _STORED)
        if start is not None:
            rows = rows.filter(F.date_add("chunk_start", F.col("chunk_days")) > F.to_date(instant(start)))
        if end is not None:
            rows = rows.filter(F.col("chunk_start") <= F.to_date(instant(end)))
        return _with_ids(rows.filter(contained(start, end)))

    def changes(self, max_files: int | None = None) -> DataFrame:
        """A stream of all versions of the rows, as they are written."""
        reader = prepare(self.spark).readStream.schema(_STORED)
        return _with_ids((reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)).parquet(self.path))

    def newest_version(self) -> int:
        """0 for a table without rows. Versions are folder names, so no column is read."""
        return self.versions().agg(F.max("version")).first()[0] or 0

    def upsert(self, facts: DataFrame, version: int | None = None) -> int:
        """Write rows (unique by key, as windows are) as one version, which replaces older ones."""
        version = self.newest_version() + 1 if version is None else version
        write_facts(facts.select(*_names(FACTS)), f"{self.path}/version={version}", "overwrite", self.chunk_days)
        return version

    def read(self, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
        """Current rows. The versions of a key lie in one chunk, so a range sees all of them or none."""
        return self.newest_of(self.versions(start, end))

    def newest_of(self, rows: DataFrame) -> DataFrame:
        """The newest of some versions that has all versions of a key or none.

        Rows of the newest version of a chunk are current as they are; only those of older ones meet
        the keys of later ones. What the driver gets is one row for each chunk.
        """
        span = F.min("version").alias("oldest"), F.max("version").alias("newest")
        chunks = rows.groupBy("chunk_days", "chunk_start").agg(*span).collect()
        if len({r.chunk_days for r in chunks}) > 1:  # a key may lie in chunks of two widths
            first, last = min(r.oldest for r in chunks), max(r.newest for r in chunks)
            chunks = [Row(chunk_start=r.chunk_start, oldest=first, newest=last) for r in chunks]
        if all(r.oldest == r.newest for r in chunks):
            return rows.select(*_names(FACTS))
        newest = _in_versions((r.chunk_start, r.newest) for r in chunks)
        oldest = _in_versions((r.chunk_start, r.oldest) for r in chunks)
        return self._not_replaced(rows.filter(~newest), rows.filter(~oldest)).union(rows.filter(newest).select(*_names(FACTS)))

    def _not_replaced(self, rows: DataFrame, others: DataFrame) -> DataFrame:
        """Rows whose key has no later version among others."""
        with_key = lambda df: df.withColumns(_short_id()) if "row_id" in self.key else df
        keys = [k for c in self.key for k in (_short_id() if c == "row_id" else [c])]
        names = {k: f"_other_{i}" for i, k in enumerate([*keys, "version"])}
        others = with_key(others).select(*[F.col(k).alias(n) for k, n in names.items()])
        later = [F.col(k).eqNullSafe(F.col(names[k])) for k in keys] + [F.col("version") < F.col(names["version"])]
        kept = with_key(rows).drop(*(["row_id"] if "row_id" in self.key else []))
        kept = kept.join(others, functools.reduce(Column.__and__, later), "left_anti")
        return (kept.withColumn("row_id", _whole_id()) if "row_id" in self.key else kept).select(*_names(FACTS))

    def compacted(self, path: str) -> FactTable:
        """The current rows as the only version of a table in a fresh folder."""
        return self._moved(self.read(), path)

    def retained(self, cut_off: datetime, path: str) -> FactTable:
        """The same without the chunks that ended at or before ``cut_off``."""
        days = F.lit(self.chunk_days)
        kept = F.date_add(chunk_start(F.col("start_time"), self.chunk_days), days) > F.to_date(instant(cut_off))
        return self._moved(self.read().filter(kept), path)

    def _moved(self, rows: DataFrame, path: str) -> FactTable:
        table = FactTable(self.spark, path, self.chunk_days, self.key)
        table.upsert(rows, max(self.newest_version(), 1))
        return table


def _in_versions(chunks: Iterable[tuple[date | None, int]]) -> Column:
    """Rows in these (chunk, version). Both are folder names, so no other folder is read."""
    by_version = defaultdict(list)
    for day, version in chunks:
        by_version[version].append(day)
    found = F.lit(False)
    for version, days in by_version.items():
        day = F.coalesce(F.col("chunk_start").isin([d for d in days if d]), F.lit(None in days))
        found = found | ((F.col("version") == version) & day)
    return found


def _short_id() -> dict[str, Column]:
    """The row id in half its size where it is the text of a digest, else as it is."""
    digest = F.unhex("row_id")
    plain = F.coalesce(F.lower(F.hex(digest)) == F.col("row_id"), F.lit(False))
    return {"_digest": F.when(plain, digest), "_id": F.when(~plain, F.col("row_id"))}


def _whole_id() -> Column:
    return F.coalesce(F.lower(F.hex("_digest")), F.col("_id"))


def matching(rows: DataFrame, others: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Rows with (``left_semi``) or without (``left_anti``) a partner; a null equals a null."""
    named = others.select(*[F.col(k).alias(f"_other_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_other_{k}")) for k in keys]
    return rows.join(named, functools.reduce(Column.__and__, same), how)


def write_facts(facts: DataFrame, path: str, mode: str = "append", chunk_days: int = CHUNK_DAYS) -> None:
    """Chunk folders, sorted by name so that row-group ranges on it are narrow.

    Rebalancing makes few files per chunk and splits a large chunk over several tasks. Row ids,
    which hardly compress, are not stored where they follow from the other columns.
    """
    order = ["chunk_days", "chunk_start", "name", "start_time"]
    follows = F.col("row_id").eqNullSafe(_id_of_row())
    short = facts.withColumns({"id_follows": follows, "row_id": F.when(~follows, F.col("row_id"))})
    (
        with_chunk(short, chunk_days)
        .hint("rebalance", "chunk_start")
        .sortWithinPartitions(*order)
        .write.mode(mode)
        .option("compression", "zstd")
        .partitionBy("chunk_days", "chunk_start")
        .parquet(path)
    )


def _with_ids(stored: DataFrame) -> DataFrame:
    """Stored rows with the ids that were not stored; older files have all of them and no mark."""
    made = F.when(F.col("id_follows"), _id_of_row()).otherwise(F.col("row_id"))
    return stored.withColumn("row_id", made).drop("id_follows")


def export_facts(
    facts: DataFrame,
    path: str,
    fmt: str = "csv",
    start: datetime | None = None,
    end: datetime | None = None,
) -> None:
    """Rows inside the range (default: the last 30 days) as CSV with header, JSON lines or Parquet."""
    start, end = range_or_default(start, end)
    rows = olap_view(facts.filter(contained(start, end)))
    writer = rows.write.mode("overwrite")
    fmt = fmt.lower()
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    elif fmt in ("json", "jsonl"):
        writer.json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown export format {fmt!r}")


def import_facts(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """An earlier export back as facts; the format follows from the file names."""
    fmt = (fmt or _detect_format(spark, path)).lower()
    reader = spark.read.schema(EXPORT)
    if fmt == "csv":
        rows = reader.option("header", True).option("escape", '"').csv(path)
    elif fmt in ("json", "jsonl"):
        rows = reader.json(path)
    elif fmt == "parquet":
        rows = reader.parquet(path)
    else:
        raise ValueError(f"unknown import format {fmt!r}")
    return from_olap_view(rows)


def _detect_format(spark: SparkSession, path: str) -> str:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [p.getName()]
    if fs.getFileStatus(p).isDirectory():
        names = [s.getPath().getName() for s in fs.listStatus(p)]
    for name in names:
        for fmt in ("csv", "jsonl", "json", "parquet"):
            if f".{fmt}" in name:
                return fmt
    raise ValueError(f"cannot tell the format of {path}")


def upsert_jdbc_rows(versions: DataFrame) -> DataFrame:
    """Rows for a relational sink keyed by the window key, nested names joined by ``_``."""
    return to_table_friendly(latest_by_window_key(versions))
