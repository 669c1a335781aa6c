"""Structured Streaming ingest: landing, Bronze ingest, schema handling, routing, quarantine and
history loads (S1-S3, S6-S9, S12).

Every stream runs with an explicit schema and a checkpoint folder; ``availableNow`` processes all
pending files and stops (the checkpoint remembers which files were done, so a re-run adds only new
files and a lost executor only retries its tasks). Checkpoints and outputs must live in a shared
folder on a cluster (see ``linecast.session.scratch_path``).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import ArrayType, DataType, StringType, StructField, StructType

ISO_UTC = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
# JSON timestamps keep microseconds (Spark's default text format stops at milliseconds).
JSON_TS_OPTIONS = {"timestampFormat": ISO_UTC, "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
LANDING_TRIGGER = "60 seconds"  # delivery buffer of the studied landing stage


def _trigger(writer, trigger: str | None):
    if trigger is None or trigger == "availableNow":
        return writer.trigger(availableNow=True)
    if trigger == "once":
        return writer.trigger(once=True)
    return writer.trigger(processingTime=trigger)


def run(query: StreamingQuery, timeout_s: float | None = None) -> StreamingQuery:
    """Wait for an ``availableNow`` query to drain and stop; re-raise its failure."""
    query.awaitTermination(timeout_s)
    exc = query.exception()
    if exc is not None:
        raise exc
    return query


# -- S9 -------------------------------------------------------------------------------------------


def stamp_ingested_at(df: DataFrame, col: str = "ingested_at") -> DataFrame:
    """UTC ISO-8601 ingest time, replacing any earlier value."""
    return df.withColumn(col, F.date_format(F.current_timestamp(), ISO_UTC))


# -- S2 / S3 --------------------------------------------------------------------------------------


def merge_schemas(stored: StructType, incoming: StructType) -> StructType:
    """Stored fields in order, then fields only in ``incoming`` as nullable (names compared
    case-insensitively), also inside structs and arrays of structs. Of a field in both, the stored type
    stays: a value that does not fit it is a bad record, not a new schema."""
    known = {f.name.lower(): f for f in stored.fields}
    new = {f.name.lower(): f for f in incoming.fields}
    out = [StructField(f.name, _merge_types(f.dataType, new[k].dataType) if k in new else f.dataType, f.nullable) for k, f in known.items()]
    return StructType(out + [StructField(f.name, f.dataType, True) for k, f in new.items() if k not in known])


def _merge_types(stored: DataType, incoming: DataType) -> DataType:
    if isinstance(stored, StructType) and isinstance(incoming, StructType):
        return merge_schemas(stored, incoming)
    if isinstance(stored, ArrayType) and isinstance(incoming, ArrayType):
        return ArrayType(_merge_types(stored.elementType, incoming.elementType), True)
    return stored


def added_columns(stored: StructType, incoming: StructType) -> list[str]:
    """Names of the columns a new batch adds."""
    known = {f.name.lower() for f in stored.fields}
    return [f.name for f in incoming.fields if f.name.lower() not in known]


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns by name, case-insensitive; missing ones null, types cast with ``try_cast``
    (the warehouse load's MATCH_BY_COLUMN_NAME = CASE_INSENSITIVE)."""
    have = {c.lower(): c for c in df.columns}
    cols = []
    for f in schema.fields:
        src = have.get(f.name.lower())
        c = F.col(f"`{src}`").try_cast(f.dataType) if src is not None else F.lit(None).cast(f.dataType)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _stored_schemas(spark: SparkSession, location: str) -> list[str]:
    """Numbered schema files (complete ones) of a location, oldest first."""
    from linecast.sources.tables import _names, folder_exists

    return [n for n, _ in _names(spark, location) if folder_exists(spark, f"{location}/{n}/_SUCCESS")]


def stored_schema(spark: SparkSession, location: str) -> tuple[StructType | None, str | None]:
    """The last schema stored at a location and the time up to which files were looked at."""
    names = _stored_schemas(spark, location)
    if not names:
        return None, None
    entry = json.loads(spark.read.text(f"{location}/{names[-1]}").first()[0])
    return StructType.fromJson(entry["schema"]), entry["seen"]


def store_schema(spark: SparkSession, location: str, schema: StructType, seen: str | None = None) -> None:
    """Add the next numbered schema file; earlier ones stay."""
    names = _stored_schemas(spark, location)
    number = int(names[-1]) + 1 if names else 0
    text = json.dumps({"schema": schema.jsonValue(), "seen": seen})
    spark.createDataFrame([(text,)], "value STRING").coalesce(1).write.mode("overwrite").text(f"{location}/{number:08d}")


def infer_json_schema(spark: SparkSession, sample_path: str, schema_location: str) -> StructType:
    """S3: infer the schema of a JSON sample once and persist it; later calls reuse the stored one
    (schema inference is a full pass over the sample, never repeated per run)."""
    found, _ = stored_schema(spark, schema_location)
    if found is None:
        found = spark.read.json(sample_path).schema
        store_schema(spark, schema_location, found)
    return found


def evolving_schema(spark: SparkSession, src: str, schema_location: str, declared: StructType | None = None) -> StructType:
    """S2 + S3 before a run: the stored schema (at first the declared one) grown by the fields of the
    files that came since the last call. A new field is in the schema *before* the stream takes the
    files that carry it, so no value of it is lost; nothing is re-read on later runs."""
    import datetime as dt

    known, seen = stored_schema(spark, schema_location)
    known = known or declared
    now = dt.datetime.now(dt.UTC) - dt.timedelta(seconds=2)  # a file written just now is looked at again
    reader = spark.read.option("timeZone", "UTC")
    try:
        incoming = (reader.option("modifiedAfter", seen) if seen else reader).json(src).schema
    except AnalysisException as e:
        if e.getCondition() != "UNABLE_TO_INFER_SCHEMA" or known is None:
            raise
        incoming = StructType([])  # no new file
    merged = merge_schemas(known, incoming) if known is not None else incoming
    store_schema(spark, schema_location, merged, now.strftime("%Y-%m-%dT%H:%M:%S"))
    return merged


def read_bronze(spark: SparkSession, path: str) -> DataFrame:
    """Read a Bronze table whose files may carry different column sets (schema grown over time)."""
    return spark.read.option("mergeSchema", "true").parquet(path)


# -- S1 -------------------------------------------------------------------------------------------


def ingest_stream(
    spark: SparkSession,
    src: str,
    schema: StructType,
    dst: str,
    checkpoint: str,
    fmt: str = "json",
    trigger: str | None = "availableNow",
    options: Mapping[str, str] | None = None,
    partition_by: tuple[str, ...] = (),
    transform: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Incremental once-per-file ingest of a landing folder into a Parquet Bronze table."""
    # No timestamp pattern on read: Spark's default parser accepts ISO-8601 with or without zone
    # and any fraction of a second.
    reader = spark.readStream.schema(schema).format(fmt)
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    df = reader.load(src)
    if transform is not None:
        df = transform(df)
    writer = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return _trigger(writer, trigger).start(dst)


def ingest_json_stream(spark: SparkSession, src: str, schema: StructType, dst: str, checkpoint: str, **kw) -> StreamingQuery:
    """S1 for newline-delimited JSON landing files (drained with ``availableNow`` by default)."""
    return ingest_stream(spark, src, schema, dst, checkpoint, fmt="json", **kw)


# -- S7 -------------------------------------------------------------------------------------------


def with_arrival_partitions(df: DataFrame, arrival: str | None = None) -> DataFrame:
    """``year``/``month``/``day`` of the arrival time (UTC); the current time when no column is given."""
    t = F.current_timestamp() if arrival is None else F.col(arrival)
    return df.withColumn("year", F.year(t)).withColumn("month", F.month(t)).withColumn("day", F.dayofmonth(t))


def land_partitioned(
    df: DataFrame,
    dst: str,
    checkpoint: str | None = None,
    arrival: str | None = None,
    trigger: str | None = LANDING_TRIGGER,
) -> StreamingQuery | None:
    """Write line-JSON under ``dst/year=/month=/day=`` by arrival time. Streaming frames get a
    processing-time trigger (the landing buffer); batch frames are appended in one write."""
    out = with_arrival_partitions(df, arrival)
    if df.isStreaming:
        w = out.writeStream.format("json").options(**JSON_TS_OPTIONS).option("checkpointLocation", checkpoint)
        return _trigger(w.partitionBy("year", "month", "day"), trigger).start(dst)
    out.write.mode("append").options(**JSON_TS_OPTIONS).partitionBy("year", "month", "day").json(dst)
    return None


# -- S8 -------------------------------------------------------------------------------------------


CORRUPT = "__corrupt"


def quarantine(df: DataFrame, value_col: str, schema: StructType, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Parse JSON text once; return ``(good, bad)``. Good rows are the parsed records plus the
    ``keep`` columns; bad rows (text that is not JSON, JSON that is not an object, or a value that does
    not fit its declared type) keep all their columns and the raw text for the error folder
    (:func:`write_quarantine`). A repeated key is taken at its last value; unknown keys are ignored."""
    wide = StructType([*schema.fields, StructField(CORRUPT, StringType(), True)])
    record = F.from_json(F.col(value_col), wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    tagged = df.withColumn("__r", record)
    # An array of one object would parse as that object.
    ok = F.col("__r").isNotNull() & F.col(f"__r.{CORRUPT}").isNull() & F.ltrim(F.col(value_col)).startswith("{")
    ok = F.coalesce(ok, F.lit(False))
    good = tagged.where(ok).select(*keep, "__r.*").drop(CORRUPT)
    bad = tagged.where(~ok).drop("__r")
    return good, bad


def write_quarantine(bad: DataFrame, path: str) -> str:
    """S8 sink: undeliverable records appended as line JSON under an error prefix, by arrival day."""
    with_arrival_partitions(bad).write.mode("append").options(**JSON_TS_OPTIONS).partitionBy("year", "month", "day").json(path)
    return path


def quarantine_stream(
    stream: DataFrame,
    value_col: str,
    schema: StructType,
    good_path: str,
    bad_path: str,
    checkpoint: str,
    keep: tuple[str, ...] = (),
    trigger: str | None = "availableNow",
) -> StreamingQuery:
    """S8 on a stream: each micro-batch's parsed records go to ``good_path`` (Parquet) and its
    undeliverable raw records to ``bad_path`` (line JSON), both under ``batch_id=`` partitions
    replaced by dynamic overwrite, so a replayed batch does not duplicate either side."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        good, bad = quarantine(batch, value_col, schema, keep)
        for frame, path, fmt in ((good, good_path, "parquet"), (bad, bad_path, "json")):
            w = frame.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").format(fmt)
            w.option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").save(path)

    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return _trigger(w, trigger).start()


# -- S6 -------------------------------------------------------------------------------------------


def routed(messages: DataFrame, routes: Mapping[str, str], topic_col: str = "topic") -> DataFrame:
    """Messages of known topics with the name of their feed in ``feed``; others are skipped."""
    feed = F.element_at(F.create_map(*[F.lit(x) for pair in routes.items() for x in pair]), F.col(topic_col))
    return messages.where(F.col(topic_col).isin(list(routes))).withColumn("feed", feed).drop(topic_col)


def route_batch(
    df: DataFrame, routes: Mapping[str, str], dst: str, topic_col: str = "topic", value_col: str = "value", arrival: str | None = None
) -> None:
    """S6 + S7 for one batch: the raw payload lines of each known topic appended under
    ``dst/feed=<name>/year=/month=/day=``, in one write."""
    _lines(df, routes, topic_col, value_col, arrival).write.mode("append").partitionBy("feed", "year", "month", "day").text(dst)


def _lines(df: DataFrame, routes: Mapping[str, str], topic_col: str, value_col: str, arrival: str | None) -> DataFrame:
    out = with_arrival_partitions(routed(df, routes, topic_col), arrival)
    return out.select(F.col(value_col).cast("string").alias("value"), "feed", "year", "month", "day").where(F.col("value").isNotNull())


def route_by_topic(
    stream: DataFrame,
    routes: Mapping[str, str],
    dst: str,
    checkpoint: str,
    topic_col: str = "topic",
    value_col: str = "value",
    arrival: str | None = None,
    trigger: str | None = "availableNow",
) -> StreamingQuery:
    """S6 + S7 as a stream: the file sink partitions the lines by feed and arrival day, exactly once
    through its checkpoint. Each ``dst/feed=<name>`` is a landing folder for :func:`ingest_json_stream`."""
    w = _lines(stream, routes, topic_col, value_col, arrival).writeStream.format("text").option("checkpointLocation", checkpoint)
    return _trigger(w.partitionBy("feed", "year", "month", "day"), trigger).start(dst)


# -- S12 ------------------------------------------------------------------------------------------


def lower_names(schema: StructType) -> StructType:
    """Schema with lower-case, nullable fields (the warehouse tables' column convention)."""
    return StructType([StructField(f.name.lower(), f.dataType, True) for f in schema.fields])


def history_records(lines: DataFrame, schema: StructType, value_col: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Export lines as rows of ``schema`` (lower-case names), columns matched by name in any case, plus
    ``__bad``: true where the line is no JSON object or a value does not fit its column. Of a name in
    several cases the first in the line counts. ``keep`` columns stay."""
    record = F.from_json(F.col(value_col), "MAP<STRING, STRING>", {"mode": "PERMISSIVE"})
    rows = lines.withColumn("__e", F.when(F.ltrim(F.col(value_col)).startswith("{"), record))
    # All names in lower case, once a line; each column is then one lookup.
    rows = rows.withColumn("__k", F.transform(F.map_keys("__e"), F.lower)).withColumn("__values", F.map_values("__e"))
    firsts = F.filter("__k", lambda k, i: F.array_position(F.col("__k"), k) == i + 1)
    values = F.filter("__values", lambda v, i: F.array_position(F.col("__k"), F.get("__k", i)) == i + 1)
    rows = rows.withColumn("__m", F.when(F.size(F.array_distinct("__k")) == F.size("__k"), F.map_from_arrays("__k", "__values")).otherwise(F.map_from_arrays(firsts, values)))
    lower = lower_names(schema)
    rows = rows.select(*keep, value_col, "__m", *[F.col("__m")[f.name].alias(f"__raw_{f.name}") for f in lower.fields])
    misfit = F.lit(False)
    cols = []
    for f in lower.fields:
        text = F.col(f"__raw_{f.name}")
        value = F.try_to_timestamp(text) if f.dataType.typeName() == "timestamp" else text.try_cast(f.dataType)
        cols.append(value.alias(f.name))
        misfit = misfit | (text.isNotNull() & value.isNull())
    return rows.select(*keep, *cols, (F.col("__m").isNull() | misfit).alias("__bad"), F.col(value_col).alias("__line"))


LOAD = "load_batch"
LOAD_LEDGER_DDL = f"file STRING, n_lines LONG, n_loaded LONG, n_rejected LONG, first_error STRING, {LOAD} LONG"


def load_ledger(spark: SparkSession, checkpoint: str) -> DataFrame:
    """One row per loaded file: its lines, rows loaded, lines rejected, the first of these, and the batch."""
    from linecast.sources.tables import folder_exists

    path = f"{checkpoint}_ledger"
    return spark.read.schema(LOAD_LEDGER_DDL).parquet(path) if folder_exists(spark, path) else spark.createDataFrame([], LOAD_LEDGER_DDL)


def file_counts(rows: DataFrame) -> DataFrame:
    """Of each file of parsed lines ``(file, __at, __bad, __line)``: its lines, those loaded and rejected,
    and the first of these."""
    bad = F.col("__bad")
    counts = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(~bad).alias("n_loaded"), F.count_if(bad).alias("n_rejected"))
    # Places are numbers: a task holds one of each split and sorts no lines. The lines of the first
    # places, one a file, are then looked up.
    by_split = rows.where(bad).groupBy("file", "__at.__block").agg(F.min("__at.__line_of_split").alias("__line_of_split"))
    first = by_split.groupBy("file").agg(F.min(F.struct("__block", "__line_of_split")).alias("__at"))
    found = rows.where(bad).join(F.broadcast(first), ["file", "__at"]).select("file", F.col("__line").alias("first_error"))
    return counts.join(F.broadcast(found), "file", "left")


def load_history(
    spark: SparkSession,
    src: str,
    schema: StructType,
    dst: str,
    checkpoint: str,
    partition_day_of: str | None = "computed_at",
    trigger: str | None = "availableNow",
    errors: str | None = None,
) -> StreamingQuery:
    """Append files not loaded before; columns matched by name in any case, appends partitioned by
    batch and day. Malformed records are left out of the table; with ``errors`` their raw lines are
    appended there. A file is read and parsed once: its rows, its rejected lines and its row of the
    ledger (:func:`load_ledger`) come from that pass. Besides the checkpoint, the ledger is asked
    before a load, so a file is not loaded again where the checkpoint was lost. Blank lines are no
    records, and a file of none has no row in the ledger."""
    ledger = f"{checkpoint}_ledger"

    def replace(rows: DataFrame, path: str, fmt: str, number: int, *by: str) -> None:
        w = rows.withColumn(LOAD, F.lit(number).cast("long")).write.mode("overwrite").format(fmt)
        w.option("partitionOverwriteMode", "dynamic").partitionBy(LOAD, *by).save(path)

    def handle(batch: DataFrame, number: int) -> None:
        # A batch that is handled again must not find its own files.
        # They are broadcast, as the checkpoint's own list of files is held whole: lines stay in their splits.
        done = F.broadcast(load_ledger(spark, checkpoint).where(F.col(LOAD) < number).select("file"))
        # Place of a line in its file: the start of its split, then its order within.
        at = F.struct("__block", F.monotonically_increasing_id().alias("__line_of_split")).alias("__at")
        new = batch.select("value", "file", at).where(F.trim("value") != "").join(done, "file", "left_anti")
        rows = history_records(new, schema, keep=("file", "__at"))
        # Kept on disk, so that memory does not grow with the batch; of good lines the text is not needed.
        rows = rows.withColumn("__line", F.when(F.col("__bad"), F.col("__line"))).persist(StorageLevel.DISK_ONLY)
        try:
            good = rows.where(~F.col("__bad")).drop("__bad", "__line", "file", "__at")
            if partition_day_of:
                replace(good.withColumn("load_date", F.to_date(F.col(partition_day_of.lower()))), dst, "parquet", number, "load_date")
            else:
                replace(good, dst, "parquet", number)
            if errors is not None:
                replace(rows.where("__bad").select(F.col("__line").alias("value")), errors, "text", number)
            replace(file_counts(rows), ledger, "parquet", number)
        finally:
            rows.unpersist()

    lines = spark.readStream.format("text").load(src)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__block"))
    return _trigger(lines.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint), trigger).start()
