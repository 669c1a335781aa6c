"""Configuration dimensions and the joins that use them.

The sports configuration (one JSON document: per sport the active flag, API key, market ticker
prefix, team abbreviations and an optional weekly schedule) is read by Spark with an explicit
schema and exploded into three small tables. They are broadcast to what they are joined with: a shuffle
by sport would put all rows of a sport into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linecast.functions.text import event_ticker
from linecast.functions.timefn import TICKER_TZ, game_date, hhmm, weekday_name

CONFIG_DDL = (
    "sports MAP<STRING, STRUCT<active: BOOLEAN, odds_api_key: STRING, kalshi_prefix: STRING, "
    "team_abbr: MAP<STRING, STRING>, schedule: STRUCT<timezone: STRING, days: ARRAY<STRING>, start_time: STRING, "
    "end_time: STRING, day_schedules: MAP<STRING, STRUCT<start_time: STRING, end_time: STRING>>>>>"
)
# Defaults of the simple schedule form (whole day).
DAY_START, DAY_END = "00:00", "23:59"
TICKER_SOURCE = "tickers"


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """The configuration document as one row with a ``sports`` map."""
    return spark.read.schema(CONFIG_DDL).option("multiLine", True).json(path)


def config_from_dict(spark: SparkSession, config: dict) -> DataFrame:
    """Same as :func:`read_config` for an in-memory document (tests, notebooks)."""
    import json

    doc = spark.createDataFrame([(json.dumps(config),)], "doc STRING")
    return doc.select(F.from_json("doc", CONFIG_DDL).alias("c")).select("c.*")


def load_dims(config: DataFrame, source: str = TICKER_SOURCE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(sport_dim, team_dim, schedule_dim)`` from a configuration frame.

    A null schedule means always on (``has_schedule = false``); a scheduled sport without a row for
    a day is closed that day.
    """
    sports = config.select(F.explode("sports").alias("sport_key", "s"))
    sport_dim = sports.select(
        "sport_key",
        F.coalesce(F.col("s.active"), F.lit(False)).alias("active"),
        F.col("s.odds_api_key").alias("odds_api_key"),
        F.col("s.kalshi_prefix").alias("kalshi_prefix"),
        F.col("s.schedule").isNotNull().alias("has_schedule"),
    )
    team_dim = sports.select("sport_key", F.explode("s.team_abbr").alias("team", "abbr")).select(
        F.lit(source).alias("source"), "sport_key", "team", "abbr"
    )
    sched = sports.where(F.col("s.schedule").isNotNull()).select("sport_key", F.col("s.schedule").alias("sc"))
    simple = sched.where(F.col("sc.day_schedules").isNull()).select(
        "sport_key",
        F.col("sc.timezone").alias("tz"),
        F.explode("sc.days").alias("day"),
        F.coalesce(F.col("sc.start_time"), F.lit(DAY_START)).alias("start_time"),
        F.coalesce(F.col("sc.end_time"), F.lit(DAY_END)).alias("end_time"),
    )
    per_day = sched.where(F.col("sc.day_schedules").isNotNull()).select(
        "sport_key", F.col("sc.timezone").alias("tz"), F.explode("sc.day_schedules").alias("day", "w")
    ).select("sport_key", "tz", "day", F.col("w.start_time").alias("start_time"), F.col("w.end_time").alias("end_time"))
    schedule_dim = simple.unionByName(per_day).withColumn("day", F.lower("day"))
    return sport_dim, team_dim, schedule_dim


def active_sports(sport_dim: DataFrame) -> DataFrame:
    """Sports whose ``active`` flag is true."""
    return sport_dim.where(F.col("active"))


def in_schedule(df: DataFrame, ts: str, sport_dim: DataFrame, schedule_dim: DataFrame, sport_col: str = "sport_key", out: str = "in_schedule") -> DataFrame:
    """Is ``ts`` inside its sport's window of that local weekday (ends inclusive, minutes)?

    Sports without a schedule are always in; scheduled sports with no row for the day are out;
    sports missing from the configuration are out. Of several windows of a sport and day the earliest counts.
    """
    sd = F.broadcast(sport_dim.select(F.col("sport_key").alias("__sk"), F.col("has_schedule").alias("__has")))
    tzs = F.broadcast(schedule_dim.groupBy(F.col("sport_key").alias("__tk")).agg(F.min("tz").alias("__tz")))
    # One window per sport and day: a repeated day cannot fan rows out.
    win = schedule_dim.groupBy(F.col("sport_key").alias("__wk"), F.col("day").alias("__wd")).agg(F.min(F.struct("start_time", "end_time")).alias("__w"))
    win = F.broadcast(win.select("__wk", "__wd", F.col("__w.start_time").alias("__st"), F.col("__w.end_time").alias("__et")))
    j = df.join(sd, F.col(sport_col) == F.col("__sk"), "left").join(tzs, F.col(sport_col) == F.col("__tk"), "left")
    local = F.convert_timezone(F.lit("UTC"), F.col("__tz"), F.col(ts).cast("timestamp_ntz"))
    j = j.withColumn("__day", weekday_name(local)).withColumn("__hm", hhmm(local))
    j = j.join(win, (F.col(sport_col) == F.col("__wk")) & (F.col("__day") == F.col("__wd")), "left")
    inside = (F.col("__hm") >= F.col("__st")) & (F.col("__hm") <= F.col("__et"))
    flag = F.when(F.col("__has").isNull(), F.lit(False)).when(~F.col("__has"), F.lit(True)).otherwise(F.coalesce(inside, F.lit(False)))
    return j.select(*df.columns, flag.alias(out))


def games_to_tickers(
    games: DataFrame,
    sport_dim: DataFrame,
    team_dim: DataFrame,
    tz: str = TICKER_TZ,
    source: str = TICKER_SOURCE,
    start_col: str = "commence_time",
) -> DataFrame:
    """J3 + F4 + F5: market event ticker of each game. Games of sports without a prefix, or with a
    team lacking an abbreviation, have no ticker and drop (inner joins). ``tz='UTC'`` reproduces
    the studied consumer's date; the default Eastern date follows its documented intent."""
    prefix = sport_dim.where(F.col("kalshi_prefix").isNotNull()).select(F.col("sport_key").alias("__sk"), F.col("kalshi_prefix"))
    abbr = team_dim.where(F.col("source") == source).groupBy("sport_key", "team").agg(F.min("abbr").alias("abbr"))
    away = abbr.select(F.col("sport_key").alias("__as"), F.col("team").alias("__at"), F.col("abbr").alias("away_abbr"))
    home = abbr.select(F.col("sport_key").alias("__hs"), F.col("team").alias("__ht"), F.col("abbr").alias("home_abbr"))
    j = (
        games.join(F.broadcast(prefix), F.col("sport_key") == F.col("__sk"), "inner")
        .join(away, (F.col("sport_key") == F.col("__as")) & (F.col("away_team") == F.col("__at")), "inner")
        .join(home, (F.col("sport_key") == F.col("__hs")) & (F.col("home_team") == F.col("__ht")), "inner")
    )
    d = game_date(F.col(start_col), tz)
    out = j.select(*games.columns, "kalshi_prefix", "away_abbr", "home_abbr", d.alias("ticker_date"))
    out = out.withColumn("event_ticker", event_ticker("kalshi_prefix", "ticker_date", "away_abbr", "home_abbr"))
    return out.where(F.col("event_ticker").isNotNull())


def ticker_lookup(tickers: DataFrame, markets: DataFrame, market_cols: tuple[str, ...] | None = None) -> DataFrame:
    """Each game ticker with its markets (inner: a ticker without markets gives no row)."""
    cols = market_cols or tuple(c for c in markets.columns if c not in tickers.columns or c == "event_ticker")
    return tickers.join(markets.select(*cols), on="event_ticker", how="inner")
