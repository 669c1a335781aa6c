"""Size-bounded landing (S7): micro-batches limited by bytes as well as time, and an archive in which the
many small landed files of a day are a few files of a wanted size.

The landing folders stay as they are, since the ingest streams remember their files by name. The archive
is a versioned table: a call writes the days that are new or have grown under a fresh folder and adds one
commit that names the version of every day, so readers see whole days only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linecast.sources.tables import VERSIONS, _commits, _fs, add_commit, folder_exists, last_commit

#: Delivery buffer of the studied landing stage, in bytes.
LANDING_BYTES = 1 << 20
ARCHIVE_FILE_BYTES = 128 << 20


def bounded_lines(spark: SparkSession, src: str, max_bytes: int = LANDING_BYTES) -> DataFrame:
    """A stream of text lines (``value``) of a folder whose micro-batches end at ``max_bytes`` of files (one
    file at least). With a processing-time trigger a batch is limited by both, and so is what it lands."""
    return spark.readStream.format("text").option("maxBytesPerTrigger", str(max_bytes)).load(src).select("value")


def landed_days(spark: SparkSession, landing: str) -> dict[str, tuple[int, int]]:
    """Bytes and files of each ``year=/month=/day=`` folder; only names and sizes are looked at."""
    fs, root = _fs(spark, landing)
    out: dict[str, tuple[int, int]] = {}
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{landing}/year=*/month=*/day=*")) if fs.exists(root) else []
    for x in found or []:
        files = [f for f in fs.listStatus(x.getPath()) if f.isFile() and not f.getPath().getName().startswith(("_", "."))]
        if files:
            out["/".join(x.getPath().toString().rsplit("/", 3)[-3:])] = (sum(int(f.getLen()) for f in files), len(files))
    return out


def compact_landed(spark: SparkSession, landing: str, archive: str, before: str | None = None, file_bytes: int = ARCHIVE_FILE_BYTES) -> list[str]:
    """Archive the days of a landing folder (those before the date ``before``, where given) that no commit
    has with their present bytes and files. A day becomes files of about ``file_bytes``, its lines as they
    were, in no order. Returns the days written; without any, no commit is added."""
    done = _commits(spark, archive)
    known = (last_commit(spark, archive) or {}).get("days", {})
    days, written = dict(known), []
    for day, (size, files) in sorted(landed_days(spark, landing).items()):
        date = "-".join(part.split("=")[1].zfill(2) for part in day.split("/"))
        if (before is not None and date >= before) or (day in known and known[day]["landed"] == [size, files]):
            continue
        version = uuid.uuid4().hex
        lines = spark.read.text(f"{landing}/{day}").select("value")
        lines.repartition(-(-size // file_bytes)).write.text(f"{archive}/{VERSIONS}/{version}")
        days[day] = {"version": version, "landed": [size, files]}
        written.append(day)
    if written:
        add_commit(spark, archive, int(done[-1]) + 1 if done else 0, {"days": days})
    return written


def read_archive(spark: SparkSession, archive: str) -> DataFrame:
    """Lines of the archive with the day they landed (``year``, ``month``, ``day``)."""
    days = (last_commit(spark, archive) or {}).get("days", {}) if folder_exists(spark, archive) else {}
    out = spark.createDataFrame([], "value STRING, year INT, month INT, day INT")
    if not days:
        return out
    # One scan over all versions; the folder of a line's file tells its day.
    of = {entry["version"]: [int(p.split("=")[1]) for p in day.split("/")] for day, entry in days.items()}
    lines = spark.read.text([f"{archive}/{VERSIONS}/{v}" for v in of]).select("value", F.element_at(F.split("_metadata.file_path", "/"), -2).alias("version"))
    table = spark.createDataFrame([(v, *d) for v, d in of.items()], "version STRING, year INT, month INT, day INT")
    return lines.join(table, "version").select("value", "year", "month", "day")
