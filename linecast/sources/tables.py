"""Batch table sources and sinks: Bronze/Silver reads, signal writes, JSON export, counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType


def table_counts(tables: Mapping[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """One row per table with its row count and, when a flag column is named, flagged rows.

    Each table is one aggregate (no shuffle beyond the single-row partial merge); the rows are
    unioned, so all counts come from one action.
    """
    parts = []
    for name, (df, flag) in tables.items():
        n_flag = F.count_if(F.col(flag)) if flag else F.lit(None).cast("long")
        parts.append(df.agg(F.count(F.lit(1)).alias("n_rows"), n_flag.alias("n_flagged")).select(F.lit(name).alias("table_name"), "n_rows", "n_flagged"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


COMMITS, VERSIONS = "_commits", "_versions"


def _fs(spark: SparkSession, path: str):
    """Hadoop file system and path object of a folder (only names are handled, never data)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def folder_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def _names(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Entries of a folder with their times, sorted by name."""
    fs, p = _fs(spark, path)
    return sorted((x.getPath().getName(), int(x.getModificationTime())) for x in fs.listStatus(p)) if fs.exists(p) else []


def _commits(spark: SparkSession, path: str) -> list[str]:
    """Names of a table's complete commits, oldest first. A commit is a file that was renamed into place
    (or, in tables of earlier form, a folder with its marker); anything else is one being added."""
    fs, p = _fs(spark, f"{path}/{COMMITS}")
    if not fs.exists(p):
        return []
    found = [(x.getPath().getName(), bool(x.isFile())) for x in fs.listStatus(p)]
    return sorted(n for n, is_file in found if n.isdigit() and (is_file or folder_exists(spark, f"{path}/{COMMITS}/{n}/_SUCCESS")))


def _read_commit(spark: SparkSession, path: str, name: str) -> dict:
    import json

    return json.loads(spark.read.text(f"{path}/{COMMITS}/{name}").first()[0])


def add_commit(spark: SparkSession, path: str, number: int, entry: Mapping) -> None:
    """Add commit ``number``: a whole file is renamed onto a name that must not exist, so of two writers of
    one number the second fails, and readers see all of a commit or nothing. (On an object store
    without such a rename, one writer a table is the rule.)"""
    import json
    import uuid

    fs, folder = _fs(spark, f"{path}/{COMMITS}")
    fs.mkdirs(folder)
    jvm = spark._jvm
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}/{COMMITS}/.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(dict(entry)).encode()))
    out.close()
    rule = jvm.org.apache.hadoop.fs.Options.Rename
    rules = spark.sparkContext._gateway.new_array(rule, 1)
    rules[0] = getattr(rule, "NONE")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(draft, jvm.org.apache.hadoop.fs.Path(f"{path}/{COMMITS}/{number:012d}"), rules)
    except Exception:
        fs.delete(draft, False)
        raise


def written_schema(df: DataFrame, partition_by_day: str | None = "computed_at") -> StructType:
    """Schema a frame has once written by :func:`write_signals` and read back."""
    fields = list(df.schema.fields)
    if partition_by_day:
        fields.append(StructField("computed_date", DateType(), True))
    return StructType(fields)


def write_signals(
    df: DataFrame,
    path: str,
    partition_by_day: str | None = "computed_at",
    mode: str = "overwrite",
    dynamic: bool = False,
    versioned: bool = False,
    flag: str | None = None,
) -> str:
    """Write a signal table as Parquet in one action.

    With ``partition_by_day`` the table is partitioned by the UTC date of that column, so later reads
    prune by day. ``overwrite`` replaces the whole table (the job is a full recompute); ``dynamic``
    replaces only the day partitions written. ``versioned`` writes into a fresh version folder and then
    adds a commit, an immutable numbered file with the version, its schema, its latest batch time, and
    its rows (and, with ``flag``, flagged rows), all observed while writing; :func:`read_signals` follows
    the highest commit, so readers see the old or the new table and never a half-written one, and a
    writer that dies leaves the old one standing.
    """
    return _write(df, path, partition_by_day, mode, dynamic, versioned, flag)


def _write(df: DataFrame, path: str, day: str | None, mode: str, dynamic: bool, versioned: bool, flag: str | None, **options: str) -> str:
    import uuid

    spark = df.sparkSession
    w = df
    if day and "computed_date" not in df.columns:
        w = w.withColumn("computed_date", F.to_date(F.col(day)))
    target = f"{path}/{VERSIONS}/{uuid.uuid4().hex}" if versioned else path
    done = _commits(spark, path) if versioned else []
    seen = Observation()
    if versioned:
        latest = F.max(F.col(day) if day else F.lit(None)).cast("string")
        flagged = F.count_if(F.col(flag)) if flag else F.max(F.lit(None)).cast("long")
        # Right below the write, in the stage that writes: a task that is repeated counts once.
        w = w.observe(seen, F.count(F.lit(1)).alias("n_rows"), flagged.alias("n_flagged"), latest.alias("latest"))
    writer = w.write.mode(mode).option("partitionOverwriteMode", "dynamic" if dynamic else "static").options(**options)
    if day:
        writer = writer.partitionBy("computed_date")
    writer.parquet(target)
    if versioned:
        counts = seen.get
        schema = written_schema(df.drop("computed_date"), day)
        number = int(done[-1]) + 1 if done else 0
        # The number follows the commits seen before writing, so a writer that was overtaken fails.
        add_commit(spark, path, number, {"version": target.rsplit("/", 1)[1], "schema": schema.jsonValue(), "day": day, "flag": flag, **counts})
    return target


def cluster_signals(spark: SparkSession, path: str, by: Sequence[str] = ("home_team", "away_team"), row_group_bytes: int = 16 << 20) -> str:
    """Rewrite the last version of a versioned table with its days range-clustered by ``by``, under a new
    commit: each file and row group of a day then holds a few games, so that their minima and maxima,
    and a Bloom filter of each of these columns, let a one-game read (P9, T3, T4) skip the others. The
    range sample reads the clustering columns of the stored table alone."""
    commit = last_commit(spark, path)
    if commit is None:
        raise ValueError(f"{path} has no versions")
    rows = read_signals(spark, path)
    order = [c for c in ("computed_date", *by) if c in rows.columns]
    blooms = {f"parquet.bloom.filter.enabled#{c}": "true" for c in by}
    clustered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return _write(clustered, path, commit["day"], "overwrite", False, True, commit["flag"], **{"parquet.block.size": str(row_group_bytes)}, **blooms)


def commit_counts(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """S14 of versioned tables from their commits: no data file and no footer is opened."""
    rows = []
    for name, path in paths.items():
        commit = last_commit(spark, path) or {}
        rows.append((name, commit.get("n_rows"), commit.get("n_flagged")))
    return spark.createDataFrame(rows, "table_name STRING, n_rows LONG, n_flagged LONG")


def write_days(df: DataFrame, path: str, partition_by_day: str = "computed_at") -> list[str]:
    """S10 by day: the day partitions that ``df`` has rows of are replaced, all others stay; and so are the
    same days of the table's summary (``<path>_summary``, one row per day, sport and game), from the days
    just written. Rows without a day replace each other. Returns the days."""
    from linecast.operators.serving import summary_partials

    spark = df.sparkSession
    days = Observation()
    dated = df.withColumn("computed_date", F.to_date(F.col(partition_by_day)))
    dated = dated.observe(days, F.collect_set(F.coalesce(F.col("computed_date").cast("string"), F.lit(""))).alias("days"))
    replace = {"partitionOverwriteMode": "dynamic"}
    dated.write.mode("overwrite").options(**replace).partitionBy("computed_date").parquet(path)
    written = sorted(days.get["days"])
    if written:
        rows = spark.read.schema(written_schema(df)).parquet(path)
        # Literal days, so that only their partitions are listed and read.
        here = F.col("computed_date").isin([d for d in written if d])
        rows = rows.where((here | F.col("computed_date").isNull()) if "" in written else here)
        partials = summary_partials(rows).repartition("computed_date")
        partials.write.mode("overwrite").options(**replace).partitionBy("computed_date").parquet(f"{path}_summary")
    return written


def read_summary(spark: SparkSession, *paths: str) -> DataFrame:
    """A2 + T6 of tables written by :func:`write_days`, from their summaries alone."""
    from linecast.operators.serving import merge_summaries

    kind = "sport_key STRING, home_team STRING, away_team STRING, n LONG, latest {}, computed_date DATE"
    parts = []
    for path in paths:
        if folder_exists(spark, f"{path}_summary"):
            parts.append(spark.read.parquet(f"{path}_summary"))
    return merge_summaries(*(parts or [spark.createDataFrame([], kind.format("TIMESTAMP"))]))


def expire_versions(spark: SparkSession, path: str, keep: int = 2, grace_seconds: int = 24 * 3600) -> list[str]:
    """Delete version folders that none of the last ``keep`` commits names and that are older than the
    grace period (running readers and writers keep theirs). Returns the deleted names."""
    import time

    live = {_read_commit(spark, path, n)["version"] for n in _commits(spark, path)[-keep:]}
    old = [n for n, t in _names(spark, f"{path}/{VERSIONS}") if n not in live and t < (time.time() - grace_seconds) * 1000]
    for name in old:
        fs, p = _fs(spark, f"{path}/{VERSIONS}/{name}")
        fs.delete(p, True)
    return old


def export_signals_json(df: DataFrame, flag_col: str, path: str) -> str:
    """Only flagged rows, newline-delimited JSON, folder overwritten."""
    from linecast.streaming.ingest import JSON_TS_OPTIONS

    df.where(F.col(flag_col)).write.mode("overwrite").options(**JSON_TS_OPTIONS).json(path)
    return path


def last_commit(spark: SparkSession, path: str) -> dict | None:
    """The highest commit of a versioned table; None for a table that was written without versions. A
    table with versions but without commits was never completed, and reading it is an error."""
    done = _commits(spark, path)
    if done:
        return _read_commit(spark, path, done[-1])
    if folder_exists(spark, f"{path}/{VERSIONS}"):
        raise RuntimeError(f"{path} holds versions but no commit: no write of it was completed")
    return None


def latest_time(spark: SparkSession, path: str) -> str | None:
    """Latest batch time of a versioned table, from its commit (no data file is opened)."""
    commit = last_commit(spark, path)
    return commit["latest"] if commit else None


def read_signals(spark: SparkSession, path: str, since: str | None = None, schema: StructType | None = None) -> DataFrame:
    """Read a signal table written by :func:`write_signals`; ``since`` prunes day partitions.

    A versioned table is read with its commit's schema, so no footer is opened for it; a table that
    was never written is an error. A batch without signals writes no data files (partitioned writes of
    an empty frame); such a version, and with ``schema`` such an unversioned folder, reads as empty."""
    commit = last_commit(spark, path)
    if commit is not None:
        schema = StructType.fromJson(commit["schema"])
        df = spark.read.schema(schema).parquet(f"{path}/{VERSIONS}/{commit['version']}")
    elif schema is not None and folder_exists(spark, path):
        df = spark.read.schema(schema).parquet(path)
    else:
        df = spark.read.option("mergeSchema", "true").parquet(path)
    if since is not None and "computed_date" in df.columns:
        df = df.where(F.col("computed_date") >= F.lit(since).cast("date"))
    return df
