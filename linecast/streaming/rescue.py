"""Ingest that loses no value: lines are parsed with the schema as it stands, and what does not fit
stays beside the typed columns until the schema has grown to it (S1 + S2).

Each micro-batch of a landing folder is read as text, once. A line becomes one Bronze row: the columns
of the schema, each null where the line's value does not fit it whole, and ``_rescued``, null where
nothing was left over, else a struct of

* ``fields``: the top-level names that did not fit: unknown fields, values of another type, and nested
  values with a part that has no place in the schema (their fitting part is in the column);
* ``line``: the whole line. A line that is no JSON object has it alone: null ``fields``, null columns.

After a batch the schema grows by the fields of *its rescued lines*, so no file is looked at before the
stream takes it, and none can slip in between. Nothing is rewritten then: :func:`read_rescued` types
the values of older rows by the schema of the time of reading.

A batch writes its rows to ``batch_id=<n>`` with dynamic overwrite, and its counts, observed while it
writes, to a ledger in the same way, so a replayed batch replaces both.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegralType, NumericType, StringType, StructType

from linecast.sources.tables import folder_exists
from linecast.streaming.ingest import _trigger, merge_schemas, store_schema, stored_schema

RESCUED, BATCH = "_rescued", "batch_id"
RESCUED_DDL = "STRUCT<fields: ARRAY<STRING>, line: STRING>"
LEDGER_DDL = f"n_rows LONG, n_rescued LONG, n_broken LONG, {BATCH} LONG"
#: New top-level names that one batch may bring into the schema. A batch with more (keys that are data)
#: leaves the schema as it is; its values stay in ``_rescued`` and lose nothing.
MAX_NEW_FIELDS = 1000


def _named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _path(name: str) -> str | None:
    """Variant path of a field; None for the few names that no path can spell. Those are never known fields,
    so their values stay in ``_rescued``."""
    if name and not set(name) & set("'?"):
        return f"$['{name}']"
    if name and not set(name) & set('"?'):
        return f'$["{name}"]'
    return f"$.{name}" if name and not set(name) & set(".[") else None


def _field(value: Column, name: str) -> Column:
    path = _path(name)
    return F.lit(None).cast("variant") if path is None else F.try_variant_get(value, path, "variant")


def _names(kind: StructType) -> Column:
    return F.array(*[F.lit(f.name) for f in kind.fields if _path(f.name)]).cast("array<string>")


def _keys(value: Column) -> Column:
    """Field names of an object; null for any other value."""
    return F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))


def fits(value: Column, kind: DataType) -> Column:
    """True where all of a VARIANT value has a place in ``kind``: objects name only known fields, list
    elements fit their element type, and a single value comes back from the type as it was. Null fits."""
    text = F.to_json(value)
    if isinstance(kind, StructType):
        inner = F.size(F.array_except(_keys(value), _names(kind))) == 0  # null for no object
        for f in kind.fields:
            inner = inner & fits(_field(value, f.name), f.dataType)
    elif isinstance(kind, ArrayType):
        inner = F.forall(F.try_variant_get(value, "$", "array<variant>"), lambda x: fits(x, kind.elementType))
    elif isinstance(kind, StringType):
        inner = F.lit(True)  # other kinds keep their JSON text
    elif isinstance(kind, (IntegralType, BooleanType)):
        inner = F.try_variant_get(value, "$", kind.simpleString()).cast("string") == text
    elif isinstance(kind, NumericType):
        inner = F.try_variant_get(value, "$", kind.simpleString()).isNotNull() & ~text.startswith('"')
    else:
        inner = F.try_variant_get(value, "$", kind.simpleString()).isNotNull()
    return value.isNull() | F.is_variant_null(value) | F.coalesce(inner, F.lit(False))


def typed(value: Column, kind: DataType) -> Column:
    """The part of a VARIANT value that fits ``kind``."""
    if isinstance(kind, StringType):
        return F.when(~F.is_variant_null(value), F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value)))
    if isinstance(kind, (StructType, ArrayType)):
        return F.try_variant_get(value, "$", kind.simpleString())
    return F.when(fits(value, kind), F.try_variant_get(value, "$", kind.simpleString()))


def _object(line: Column | str) -> Column:
    """A line as VARIANT; null unless it is one JSON object (without a repeated name)."""
    c = F.col(line) if isinstance(line, str) else line
    return F.when(F.ltrim(c).startswith("{"), F.try_parse_json(c))


def parse_lines(lines: DataFrame, schema: StructType, value_col: str = "value") -> DataFrame:
    """Rows of ``schema`` plus ``_rescued`` from JSON lines. Other columns stay, unless the schema has
    their name. Blank and null lines are no records and go."""
    taken = {f.name.lower() for f in schema.fields} | {RESCUED, value_col.lower()}
    keep = [_named(c) for c in lines.columns if c.lower() not in taken]
    rows = lines.where(F.trim(value_col) != "").withColumn("__v", _object(value_col))
    v = F.col("__v")
    parts = rows.select(*keep, value_col, "__v", *[_field(v, f.name).alias(f"__f{i}") for i, f in enumerate(schema.fields)])
    part = [F.col(f"__f{i}") for i in range(len(schema.fields))]
    unknown = F.array_except(_keys(v), _names(schema))
    misfit = F.array_compact(F.array(*[F.when(~fits(p, f.dataType), F.lit(f.name)) for p, f in zip(part, schema.fields, strict=True)]).cast("array<string>"))
    left = parts.withColumn("__left", F.concat(unknown, misfit))
    rescued = F.when(v.isNull(), F.struct(F.lit(None).cast("array<string>").alias("fields"), F.col(value_col).alias("line")))
    rescued = rescued.when(F.size("__left") > 0, F.struct(F.col("__left").alias("fields"), F.col(value_col).alias("line")))
    values = [typed(p, f.dataType).alias(f.name) for p, f in zip(part, schema.fields, strict=True)]
    return left.select(*keep, *values, rescued.alias(RESCUED))


def _variant_type(ddl: str) -> StructType:
    """The struct that a schema of variant objects names. Numbers with a point are doubles; a field of no
    common kind, or of none but null, is text."""
    text = re.sub(r"\bDECIMAL\(\d+,\s*\d+\)", "DOUBLE", re.sub(r"\bOBJECT<", "STRUCT<", ddl))
    text = re.sub(r"\b(VOID|VARIANT)\b", "STRING", text).replace("STRUCT<>", "STRING")
    return StructType.fromDDL(f"x {text}").fields[0].dataType


def rescued_fields(rows: DataFrame) -> StructType:
    """All fields of the rescued lines that are JSON objects, with the type their values have in common."""
    lines = rows.where(F.col(f"{RESCUED}.fields").isNotNull())
    new = lines.select(F.explode(f"{RESCUED}.fields")).distinct().limit(MAX_NEW_FIELDS + 1).count()
    if not 0 < new <= MAX_NEW_FIELDS:
        return StructType([])
    found = lines.agg(F.schema_of_variant_agg(_object(F.col(f"{RESCUED}.line")))).first()[0]
    kind = _variant_type(found)
    return kind if isinstance(kind, StructType) else StructType([])


def grown(stored: StructType, incoming: StructType) -> StructType:
    """``stored`` with the new fields of ``incoming``; names that differ in case alone are one column to
    Parquet, so only the first is added and the others stay rescued."""
    first: dict[str, str] = {}
    for f in incoming.fields:
        first.setdefault(f.name.lower(), f.name)
    return merge_schemas(stored, StructType([f for f in incoming.fields if first[f.name.lower()] == f.name and _path(f.name)]))


def ingest_rescued(
    spark: SparkSession,
    src: str,
    declared: StructType,
    dst: str,
    checkpoint: str,
    trigger: str | None = "availableNow",
    after_batch: Callable[[int], None] | None = None,
) -> StreamingQuery:
    """S1 + S2: once-per-file ingest of a folder of JSON lines into the Bronze table ``dst``.

    The schema starts as ``declared`` and is kept in ``<checkpoint>_schema``, the ledger in
    ``<checkpoint>_ledger``. ``after_batch`` is called with the number of each batch that is done.
    """
    location, ledger = f"{checkpoint}_schema", f"{checkpoint}_ledger"

    def handle(batch: DataFrame, number: int) -> None:
        schema = stored_schema(spark, location)[0] or declared
        seen = Observation()
        left = F.col(RESCUED).isNotNull()
        rows = parse_lines(batch.select("value"), schema).withColumn(BATCH, F.lit(number))
        rows = rows.observe(
            seen, F.count(F.lit(1)).alias("n_rows"), F.count_if(left).alias("n_rescued"), F.count_if(left & F.col(f"{RESCUED}.fields").isNull()).alias("n_broken")
        )
        _replace(rows, dst)
        counts = seen.get
        if counts["n_rescued"] > counts["n_broken"]:
            written = spark.read.schema(f"{RESCUED} {RESCUED_DDL}, {BATCH} LONG").parquet(dst).where(F.col(BATCH) == number)
            wide = grown(schema, rescued_fields(written))
            if wide != schema:
                store_schema(spark, location, wide)
        _replace(spark.createDataFrame([(counts["n_rows"], counts["n_rescued"], counts["n_broken"], number)], LEDGER_DDL).coalesce(1), ledger)
        if after_batch is not None:
            after_batch(number)

    if stored_schema(spark, location)[0] is None:
        store_schema(spark, location, declared)
    w = spark.readStream.format("text").load(src).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return _trigger(w, trigger).start()


def _replace(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(path)


def ingest_ledger(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Rows, rescued rows and broken lines of each batch of :func:`ingest_rescued`."""
    path = f"{checkpoint}_ledger"
    if not folder_exists(spark, path):
        return spark.createDataFrame([], LEDGER_DDL)
    return spark.read.schema(LEDGER_DDL).parquet(path)


def read_rescued(spark: SparkSession, dst: str, checkpoint: str, schema: StructType | None = None) -> DataFrame:
    """A Bronze table by its schema of now (or ``schema``): rescued values that fit it are in their
    columns, and ``_rescued`` names what still does not. No footer is opened for the schema."""
    schema = schema or stored_schema(spark, f"{checkpoint}_schema")[0]
    if schema is None:
        raise ValueError(f"no schema is stored for {checkpoint}")
    full = StructType(list(schema.fields)).add(RESCUED, StructType.fromDDL(f"x {RESCUED_DDL}").fields[0].dataType).add(BATCH, "long")
    if not folder_exists(spark, dst):
        return spark.createDataFrame([], full)
    rows = spark.read.schema(full).parquet(dst)
    left = F.col(f"{RESCUED}.fields")
    rows = rows.withColumn("__v", F.when(left.isNotNull(), _object(F.col(f"{RESCUED}.line"))))
    fields = schema.fields
    parts = rows.select("*", *[F.when(F.array_contains(left, f.name), _field(F.col("__v"), f.name)).alias(f"__f{i}") for i, f in enumerate(fields)])
    values = [F.when(F.col(f"__f{i}").isNotNull(), typed(F.col(f"__f{i}"), f.dataType)).otherwise(_named(f.name)).alias(f.name) for i, f in enumerate(fields)]
    settled = F.array_compact(F.array(*[F.when(F.array_contains(left, f.name) & fits(F.col(f"__f{i}"), f.dataType), F.lit(f.name)) for i, f in enumerate(fields)]).cast("array<string>"))
    still = F.array_except(left, settled)
    rescued = F.when(left.isNull(), F.col(RESCUED)).when(F.size(still) > 0, F.struct(still.alias("fields"), F.col(f"{RESCUED}.line").alias("line")))
    return parts.select(*values, rescued.alias(RESCUED), BATCH)
