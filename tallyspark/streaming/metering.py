"""The metering run as two chained streams.

The first labels each micro-batch with the newest rules and writes it out; the second keeps
the windows in its state and upserts every window it touches. Labelling is not row-local for
large rule sets, so it happens per batch and not inside the stateful query.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyspark.config import MeteringConfig
from tallyspark.functions.buckets import instant
from tallyspark.functions.maps import canonical_json
from tallyspark.functions.normalize import normalize
from tallyspark.operators.labels import INLINE_RULES, CompiledRules, compile_rules, context_segments, enrich, label
from tallyspark.operators.pricing import price
from tallyspark.operators.split import split_among_principals
from tallyspark.operators.windows import window_columns, window_groups
from tallyspark.plans.metering import window_floor
from tallyspark.schemas import MAP
from tallyspark.session import prepare, written
from tallyspark.sources.facts import FactTable, to_facts, to_table_friendly, write_windowed

Loader = Callable[[SparkSession], DataFrame]

LABELLED = (
    "event_time TIMESTAMP, entity_type STRING, name STRING, initial_metric_name STRING, "
    "value DOUBLE, context_json STRING"
)
SEGMENTS = f"entity_type STRING, name STRING, seg_from TIMESTAMP, seg_until TIMESTAMP, context {MAP}, batch_id BIGINT"
RUNS = "number INT, start_time TIMESTAMP, first_version INT"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _rename(spark: SparkSession, source: str, target: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(target).getParent())
    if not fs.rename(path(source), path(target)):
        raise OSError(f"cannot publish {source} as {target}")


def _exists(spark: SparkSession, target: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def rule_epoch(rules: DataFrame) -> str:
    """A digest of the rules that says whether any has changed; the order of the rows has no part in it."""
    plain = [canonical_json(F.col(c)) if t.startswith("map") else F.col(c) for c, t in rules.dtypes]
    # a null and the column after it must not change places unnoticed
    row = [x for c in plain for x in (c.isNull(), c)]
    sums = [F.sum(F.xxhash64(F.lit(seed), *row).cast("decimal(38,0)")) for seed in (1, 2)]
    return "_".join(str(x or 0) for x in rules.agg(F.count("*"), *sums).first())


def remembered_segments(metrics: DataFrame, batch_id: int, path: str, compiled: CompiledRules) -> DataFrame:
    """The validity ranges of the entities of ``metrics``; only entities that ``path`` lacks meet the rules.

    Each batch adds a folder with its new entities, those without a match too, and a replay
    replaces its own.
    """
    spark, entity = metrics.sparkSession, ["entity_type", "name"]
    seen = metrics.filter(F.col("entity_type").isin(*compiled.types)).select(*entity).distinct()
    try:
        known = spark.read.schema(SEGMENTS).parquet(path).filter(F.col("batch_id") != batch_id)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        known = spark.createDataFrame([], SEGMENTS)
    unknown = written(seen.join(known.select(*entity), entity, "left_anti"), "unknown")
    found = unknown.join(context_segments(unknown, compiled), entity, "left")
    found.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    every = spark.read.schema(SEGMENTS).parquet(path).filter(F.col("seg_from").isNotNull()).drop("batch_id")
    return every.join(seen, entity, "left_semi")


def label_batch(
    batch: DataFrame,
    batch_id: int,
    out: str,
    config: MeteringConfig,
    load_rules: Loader,
    remember: bool = False,
    max_inline: int = INLINE_RULES,
) -> None:
    """Label one micro-batch into ``out/batch_id=N``.

    The folder appears whole by a rename, and a replayed batch that is already there is
    skipped: the windows downstream must not read a record twice. With ``remember`` what large
    rule sets say of an entity is kept below ``out/_labels`` for the batches to come, in a folder
    of its own for each state of the rules; folders of former states are not read again. What was
    compiled of rules is kept below ``out/_rules``, so that a changed rule is the only one compiled.
    """
    spark = batch.sparkSession
    target = f"{out}/batch_id={batch_id}"
    if _exists(spark, target):
        return
    rules = load_rules(spark)
    compiled = compile_rules(rules, max_inline, f"{out}/_rules" if remember else None)
    metrics = normalize(batch, config.principal_tags)
    two_passes = compiled.inline is None
    if two_passes:
        metrics = metrics.persist()
    try:
        if two_passes and remember:
            segments = remembered_segments(metrics, batch_id, f"{out}/_labels/{rule_epoch(rules)}", compiled)
            labelled = enrich(metrics, segments, types=compiled.types, many=compiled.boundaries is None)
        else:
            labelled = label(metrics, compiled)
        rows = split_among_principals(labelled, config, compiled)
        staged = f"{out}/_staging/batch_id={batch_id}"
        rows.withColumn("context_json", canonical_json(F.col("context"))).select(
            "event_time", "entity_type", "name", "initial_metric_name", "value", "context_json"
        ).write.mode("overwrite").parquet(staged)
    finally:
        if two_passes:
            metrics.unpersist()
    _rename(spark, staged, target)


def start_labelling(
    raw: DataFrame,
    base: str,
    config: MeteringConfig,
    load_rules: Loader,
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """``load_rules`` runs once per micro-batch, so a rule change takes effect one batch later;
    options as of ``label_batch``."""
    out = f"{base}/labelled"
    return (
        raw.writeStream.foreachBatch(lambda df, n: label_batch(df, n, out, config, load_rules, **options))
        .option("checkpointLocation", f"{base}/checkpoints/labelling")
        .trigger(**(trigger or {"processingTime": "10 seconds"}))
        .queryName("tallyspark-labelling")
        .start()
    )


def windowed_stream(labelled: DataFrame, config: MeteringConfig) -> DataFrame:
    """Windows over a stream of labelled rows; the watermark bounds the state."""
    return window_groups(labelled.withWatermark("event_time", config.watermark), config)


def start_windows(
    spark: SparkSession,
    base: str,
    config: MeteringConfig,
    load_prices: Loader,
    trigger: dict | None = None,
    first_version: int = 1,
    max_files: int | None = None,
    sinks: bool = False,
    facts: str | None = None,
) -> StreamingQuery:
    """Each update of a window is priced by the newest rule and upserted into ``facts``
    (``base/facts`` by default).

    With ``sinks`` each batch also writes the result stream (``base/windowed``) and its table-friendly twin
    (``base/table_friendly``), one folder a batch, so that a replay replaces its own.

    The version of an upsert follows from the batch number, so a replay replaces its own
    rows. A new checkpoint needs a ``first_version`` above all versions written before.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    _mkdirs(spark, f"{base}/labelled")
    reader = spark.readStream.schema(LABELLED)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    labelled = reader.parquet(f"{base}/labelled")

    def upsert(updates: DataFrame, batch_id: int) -> None:
        session = updates.sparkSession
        priced = price(window_columns(updates), load_prices(session))
        if sinks:
            priced = written(priced, "windows")
            write_windowed(priced, f"{base}/windowed/batch_id={batch_id}", "overwrite")
            to_table_friendly(priced).write.mode("overwrite").parquet(f"{base}/table_friendly/batch_id={batch_id}")
        FactTable(session, facts or f"{base}/facts").upsert(to_facts(priced), first_version + batch_id)

    return (
        windowed_stream(labelled, config)
        .writeStream.outputMode("update")
        .foreachBatch(upsert)
        .option("checkpointLocation", f"{base}/checkpoints/windows")
        .trigger(**(trigger or {"processingTime": "15 seconds"}))
        .queryName("tallyspark-windows")
        .start()
    )


def _mkdirs(spark: SparkSession, target: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


def run_available(
    raw: DataFrame,
    base: str,
    config: MeteringConfig,
    load_rules: Loader,
    load_prices: Loader,
    max_files: int | None = None,
    **window_options,
) -> None:
    """Both streams over what is there now, one after the other; options as of ``start_windows``."""
    spark = prepare(raw.sparkSession)
    now = {"availableNow": True}
    start_labelling(raw, base, config, load_rules, now).awaitTermination()
    start_windows(spark, base, config, load_prices, now, max_files=max_files, **window_options).awaitTermination()


def current_run(spark: SparkSession, base: str) -> tuple[int, datetime | None, int]:
    """(number, start time, first version) of the newest run; before any reprocessing (0, None, 1)."""
    try:
        rows = spark.read.schema(RUNS).parquet(f"{base}/runs")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, None, 1
    number, micros, first = rows.select("number", F.unix_micros("start_time"), "first_version").orderBy(F.desc("number")).first()
    return number, None if micros is None else datetime.fromtimestamp(0, timezone.utc) + timedelta(microseconds=micros), first


def reprocess_from(spark: SparkSession, base: str, config: MeteringConfig, start_time: datetime | None = None) -> int:
    """The next ``run_current`` reads all records from ``start_time`` on anew (null: from the beginning).

    Stop the streams before. The new run has checkpoints and labelled rows of its own and goes on
    with the records to come; its versions lie above all that the fact table holds, so its facts
    replace those of equal row ids. The start moves back to its window boundary.
    """
    prepare(spark)
    number = current_run(spark, base)[0] + 1
    start = None if start_time is None else window_floor(start_time, config)
    first = FactTable(spark, f"{base}/facts").newest_version() + 1
    spark.createDataFrame([(number, start, first)], RUNS).write.mode("error").parquet(f"{base}/runs/run={number}")
    return number


def run_current(
    raw: DataFrame, base: str, config: MeteringConfig, load_rules: Loader, load_prices: Loader, **window_options
) -> None:
    """As ``run_available``, for the newest run of ``base``."""
    number, start, first = current_run(raw.sparkSession, base)
    if start is not None:
        raw = raw.filter(F.col("event_time") >= instant(start))
    folder = f"{base}/run-{number}" if number else base
    run_available(raw, folder, config, load_rules, load_prices, first_version=first, facts=f"{base}/facts", **window_options)
