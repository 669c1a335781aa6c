"""Corrected sharp-money signals in any arrival order, and streams with bounded state."""

import glob
import random
import tempfile

from pyspark.sql import functions as F

from linecast.operators.movement import sharp_money
from linecast.streaming import incremental as INC
from linecast.streaming import ingest as ING
from linecast.streaming import joined as JS

ODDS = (
    "id STRING, sport_key STRING, sport_title STRING, home_team STRING, away_team STRING, commence_time TIMESTAMP, ingested_at TIMESTAMP, "
    "event_id BIGINT, bookmaker_key STRING, bookmaker_title STRING, team STRING, american_odds BIGINT, implied_prob DOUBLE"
)


def day():
    return F.date_trunc("day", F.col("ingested_at"))


def _polls(spark, n=120, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        odds = rnd.choice([-150, -120, 110, 130, None])
        rows.append(("g1", "nba", "NBA", "H", "A", None, f"2024-01-01 {rnd.randint(0, 9):02d}:{rnd.randint(0, 59):02d}:00", i, rnd.choice(["b1", "b2", None]), "B", "H", odds, odds and 0.5 + odds / 1000))
    df = spark.createDataFrame(rows, ODDS.replace("ingested_at TIMESTAMP", "ingested_at STRING").replace("commence_time TIMESTAMP", "commence_time STRING"))
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ("ingested_at", "commence_time")})


def _rows(df):
    return sorted(map(repr, df.drop("batch_id", "change").collect()))


def _feed(spark, parts, base, **kw):
    kw = dict(books=None, tie=("event_id",), late_path=f"{base}/late") | kw
    for k, part in enumerate(parts):
        INC.sharp_money_changes_batch(spark, part, k, f"{base}/out", f"{base}/state", day(), **kw)
    return spark.read.parquet(f"{base}/out")


def test_changes_sum_to_the_batch_job_in_any_order(spark):
    polls = _polls(spark)
    want = _rows(sharp_money(polls, books=None, computed_at=day(), tie=("event_id",)))
    for seed in (1, 2):
        base = tempfile.mkdtemp(prefix="lc-chg-")
        part = F.pmod(F.xxhash64("event_id", F.lit(seed)), F.lit(3))
        out = _feed(spark, [polls.where(part == k) for k in range(3)], base)
        assert _rows(INC.current_signals(out)) == want
        assert out.where("change < 0").count() > 0  # late rows cancelled moves
        assert not glob.glob(f"{base}/late/**/*.parquet", recursive=True)


def test_repeated_batch_replaces_its_changes(spark):
    polls = _polls(spark, 60)
    base = tempfile.mkdtemp(prefix="lc-rep-")
    halves = [polls.where("event_id % 2 = 1"), polls.where("event_id % 2 = 0")]
    _feed(spark, halves, base)
    INC.sharp_money_changes_batch(spark, halves[1], 1, f"{base}/out", f"{base}/state", day(), books=None, tie=("event_id",), late_path=f"{base}/late")
    want = _rows(sharp_money(polls, books=None, computed_at=day(), tie=("event_id",)))
    assert _rows(INC.current_signals(spark.read.parquet(f"{base}/out"))) == want


def test_rows_beyond_the_delay_and_without_time_stand_aside(spark):
    polls = _polls(spark)
    base = tempfile.mkdtemp(prefix="lc-delay-")
    none = polls.where("event_id = 3").withColumn("ingested_at", F.lit(None).cast("timestamp"))
    late = F.col("event_id") % 5 == 0
    out = _feed(spark, [polls.where(~late), polls.where(late).unionByName(none)], base, delay_seconds=3 * 3600)
    newest = polls.where(~late).agg(F.max("ingested_at")).first()[0]
    aside = late & (F.col("ingested_at") < F.lit(newest) - F.expr("INTERVAL 3 HOURS"))
    assert spark.read.parquet(f"{base}/late").count() == polls.where(aside).count() + 1 > 3
    assert _rows(INC.current_signals(out)) == _rows(sharp_money(polls.where(~aside), books=None, computed_at=day(), tie=("event_id",)))
    state = spark.read.parquet(f"{base}/state").where("slot = 1")
    old = state.where(F.col("__ts") < F.lit(newest) - F.expr("INTERVAL 3 HOURS"))
    assert old.groupBy("bookmaker_key").count().agg(F.max("count")).first()[0] == 1  # one row a series before the delay


def test_redelivered_messages_arrive_once(spark):
    base = tempfile.mkdtemp(prefix="lc-dd-")
    log = spark.range(200).select("id", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int"))).alias("ts"))
    dropped = 0
    for k in range(3):
        log.where(F.col("id") < 100 * (k + 1)).write.parquet(f"{base}/log/part={k}")
        stream = spark.readStream.schema(log.schema).parquet(f"{base}/log/part=*")
        q = ING.run(JS.dedup_stream(stream, f"{base}/out", f"{base}/ckpt", ["id"], "ts", "1 day"))
        dropped += JS.dropped_repeats(q)["repeats"]
    assert sorted(r.id for r in spark.read.parquet(f"{base}/out").collect()) == list(range(200))
    assert dropped == 300


def test_quotes_before_and_after_their_game_event_match(spark):
    base = tempfile.mkdtemp(prefix="lc-join-")
    games = spark.createDataFrame([("g", "2024-01-01 10:00:00"), ("h", "2024-01-01 12:00:00"), (None, "2024-01-01 10:00:00")], "k STRING, gt STRING").withColumn("gt", F.col("gt").cast("timestamp"))
    times = [("g", "09:45"), ("g", "10:30"), ("g", "11:30"), ("h", "11:50"), ("h", "11:00"), (None, "10:00")]
    quotes = spark.createDataFrame([(k, f"2024-01-01 {t}:00") for k, t in times], "k STRING, qt STRING").withColumn("qt", F.col("qt").cast("timestamp"))
    for early in (True, False):  # quotes that come before, and in a later run than, their event
        quotes.where((F.minute("qt") > 40) == early).write.mode("append").parquet(f"{base}/q")
        games.where((F.col("k") == "h") == early).write.mode("append").parquet(f"{base}/g")
        g, q = (spark.readStream.schema(f.schema).parquet(f"{base}/{n}") for n, f in (("g", games), ("q", quotes)))
        ING.run(JS.join_quotes(g, q, f"{base}/out", f"{base}/ckpt", keys=["k"], game_ts="gt", quote_ts="qt", before="30 minutes", after="1 hour", delay="1 day"))
    got = sorted((r.k, str(r.qt)[11:16]) for r in spark.read.parquet(f"{base}/out").collect())
    assert got == [("g", "09:45"), ("g", "10:30"), ("h", "11:50")]


def test_quotes_meet_only_the_games_near_them(spark):
    """Times on both ends of the window and of its slots, before and after 1970; one game holds all rows."""
    games = spark.range(-3, 4).select(F.lit(1).alias("k"), F.timestamp_seconds(F.col("id") * 2700).alias("gt"))
    quotes = spark.range(-40, 41).select(F.lit(1).alias("k"), F.timestamp_seconds(F.col("id") * 450).alias("qt"))
    for before, after in (("30 minutes", "1 hour"), ("0 seconds", "0 seconds"), ("-15 minutes", "30 minutes"), ("-2 hours", "1 hour")):
        found = JS.quotes_near_games(games, quotes, ["k"], "gt", "qt", before, after)
        on = F.col("qt").between(F.col("gt") - F.expr(f"INTERVAL {before}"), F.col("gt") + F.expr(f"INTERVAL {after}"))
        expected = games.select("gt").join(quotes, on)
        assert found.columns == ["gt", "k", "qt"]
        assert sorted(map(tuple, found.select("gt", "k", "qt").collect())) == sorted(map(tuple, expected.select("gt", "k", "qt").collect()))
        keys = found._jdf.queryExecution().optimizedPlan().toString()
        assert "__g_slot" in keys and "__slot" in keys
