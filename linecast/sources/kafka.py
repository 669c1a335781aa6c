"""Kafka source and sink (S4, S5), kept behind two functions.

The Kafka connector is a separate package (``org.apache.spark:spark-sql-kafka-0-10``) that must be on
the cluster's classpath; it is not bundled here. Without it, :func:`kafka_source` raises Spark's
"Failed to find data source: kafka" when the frame is built; nothing else in the package depends
on it. Message shaping (:func:`to_messages`, :func:`decode_messages`) is plain column work and is
tested with file sources.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Fixed topic names of the studied feeds.
TOPICS = {"odds": "raw-odds", "game_events": "raw-game-events", "kalshi": "raw-kalshi-markets"}


def kafka_source(
    spark: SparkSession,
    bootstrap: str,
    topics: Sequence[str],
    starting_offsets: str = "latest",
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Subscribe to topics from the latest offsets; columns ``key, value`` as strings plus ``topic``."""
    r = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", bootstrap)
        .option("subscribe", ",".join(topics))
        .option("startingOffsets", starting_offsets)
    )
    for k, v in (options or {}).items():
        r = r.option(k, v)
    return r.load().select(
        "topic", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "timestamp"
    )


def decode_messages(messages: DataFrame, schema: StructType, value_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """JSON-decode message values with an explicit schema: ``(good, bad)`` as in S8, good rows with
    their topic, bad ones as they came."""
    from linecast.streaming.ingest import quarantine

    return quarantine(messages, value_col, schema, keep=("topic",))


def to_messages(df: DataFrame, key_cols: Sequence[str], stamp: bool = True) -> DataFrame:
    """S5 shaping: key ``a:b`` from ``key_cols``, value = the row as JSON (with a fresh
    ``ingested_at`` when ``stamp``)."""
    from linecast.streaming.ingest import stamp_ingested_at

    src = stamp_ingested_at(df) if stamp else df
    return src.select(
        F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in key_cols]).alias("key"),
        F.to_json(F.struct(*[F.col(c) for c in src.columns])).alias("value"),
    )


def kafka_sink(messages: DataFrame, bootstrap: str, topic: str, checkpoint: str, options: Mapping[str, str] | None = None):
    """Write ``key, value`` messages to a topic (streaming frames start a query)."""
    opts = {"kafka.bootstrap.servers": bootstrap, "topic": topic, "kafka.compression.type": "gzip", "kafka.linger.ms": "100"}
    opts.update(options or {})
    if messages.isStreaming:
        w = messages.writeStream.format("kafka").option("checkpointLocation", checkpoint)
        for k, v in opts.items():
            w = w.option(k, v)
        return w.start()
    w = messages.write.format("kafka")
    for k, v in opts.items():
        w = w.option(k, v)
    w.save()
    return None
