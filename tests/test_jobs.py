import re
import tempfile

from pyspark.sql import functions as F

from linecast.plans import catalog as C
from linecast.plans import jobs
from linecast.plans import testdata as td

SF = "/root/testdata/sf0.001"


def test_run_all_jobs_end_to_end(spark):
    out = tempfile.mkdtemp(prefix="lc-jobs-")
    raw_odds = td.raw_odds(spark, SF).drop("event_id")
    raw_quotes = td.raw_quotes(spark, SF).drop("event_id")
    res = jobs.run_all_jobs(spark, raw_odds, raw_quotes, out, computed_at=F.date_trunc("day", F.col("ingested_at")), sharp_books=td.TEST_BOOKS)
    counts = {r[0]: (r[1], r[2]) for r in res["signals"].counts}
    # Same sharp rows as the oracle-checked query at this scale; divergence here pairs quotes with
    # per-tick consensus polls (the query uses daily polls), so only its presence is checked.
    assert counts["sharp_money_signals"][0] == 692 and counts["divergence_signals"][0] > 0
    # history: every exported (flagged) row once after dedup
    assert res["history"]["sharp"].count() == counts["sharp_money_signals"][1]
    assert res["board"]["divergence"].count() > 0 and res["board"]["summary"].count() > 0
    assert res["series"]["odds"].count() > 0


def test_job_tickers(spark):
    from linecast.operators import boards as B

    sport_dim, team_dim, _ = td.test_dims(spark, SF)
    games = B.parse_scoreboard(td.scoreboard_events(spark, SF), keep=("seq",))
    markets = spark.createDataFrame([("KXNBAGAME-98OCT02AN0HN0", "M1")], "event_ticker STRING, market_ticker STRING")
    out = jobs.job_tickers(games, sport_dim, team_dim, markets, order=("seq",))
    assert out["tickers"].count() > 0
    assert out["unmatched"].count() > 0
    assert out["markets"].count() <= 1


def test_versioned_write_swaps_pointer(spark):
    from linecast.sources import tables as T

    base = tempfile.mkdtemp(prefix="lc-ver-")
    a = spark.createDataFrame([(1, "2024-01-01 10:00:00")], "x INT, computed_at STRING").withColumn("computed_at", F.col("computed_at").cast("timestamp"))
    b = spark.createDataFrame([(2, "2024-01-02 10:00:00")], "x INT, computed_at STRING").withColumn("computed_at", F.col("computed_at").cast("timestamp"))
    T.write_signals(a, f"{base}/t", versioned=True)
    assert [r.x for r in T.read_signals(spark, f"{base}/t").collect()] == [1]
    T.write_signals(b, f"{base}/t", versioned=True)
    assert [r.x for r in T.read_signals(spark, f"{base}/t").collect()] == [2]


def test_commits_are_safe(spark):
    import pytest
    from linecast.sources import tables as T

    base = tempfile.mkdtemp(prefix="lc-commit-")
    row = spark.createDataFrame([(1, "2024-01-01 10:00:00")], "x INT, computed_at STRING").withColumn("computed_at", F.col("computed_at").cast("timestamp"))
    path = f"{base}/t"
    for _ in range(3):
        T.write_signals(row, path, versioned=True)
    assert T.latest_time(spark, path).startswith("2024-01-01 10:00:00")
    # a writer that died: its version is there, its commit is not complete
    row.withColumn("x", F.lit(9)).write.parquet(f"{path}/_versions/dead")
    import os

    os.makedirs(f"{path}/_commits/{7:012d}")
    assert [r.x for r in T.read_signals(spark, path).collect()] == [1]
    reader = T.read_signals(spark, path)  # planned before the next swap
    T.write_signals(row.withColumn("x", F.lit(2)), path, versioned=True)
    assert [r.x for r in reader.collect()] == [1] and [r.x for r in T.read_signals(spark, path).collect()] == [2]
    assert T.expire_versions(spark, path) == []  # the grace period
    gone = T.expire_versions(spark, path, keep=1, grace_seconds=-10)
    assert "dead" in gone and len(gone) == 4 and [r.x for r in T.read_signals(spark, path).collect()] == [2]
    # versions without any commit are an error, not an empty table
    row.write.parquet(f"{base}/u/_versions/v1")
    with pytest.raises(RuntimeError):
        T.read_signals(spark, f"{base}/u", schema=T.written_schema(row))
    # a batch without signals
    T.write_signals(row.limit(0), f"{base}/e", versioned=True)
    assert T.read_signals(spark, f"{base}/e").count() == 0


def test_boards_group_more_rows_than_a_feed_lists(spark):
    from linecast.operators import serving as S
    from linecast.plans import catalog

    s = catalog.sharp_silver(spark, SF, True)
    many = s.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(1500)))).withColumn("away_team", F.concat("away_team", F.lit("-"), "k")).drop("k")
    latest = S.latest_batch(many)
    assert latest.count() > S.FEED_LIMIT
    board = jobs.job_board(catalog.div_silver(spark, SF, True), many)["sharp"]
    got = board.agg(F.sum("n_rows"), F.count("*")).first()
    assert got[0] == latest.count() and got[1] == latest.select("home_team", "away_team").distinct().count()


def test_job_bronze_counts_and_rerun(spark):
    base = tempfile.mkdtemp(prefix="lc-bronze-")
    odds = td.raw_odds(spark, SF).drop("event_id").withColumn("ingested_at", F.date_format("ingested_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    quotes = td.raw_quotes(spark, SF).drop("event_id").withColumn("ingested_at", F.date_format("ingested_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    odds.write.json(f"{base}/landing/odds")
    quotes.write.json(f"{base}/landing/kalshi")
    landing = {"odds": f"{base}/landing/odds", "kalshi": f"{base}/landing/kalshi"}
    first = jobs.job_bronze(spark, landing, f"{base}/bronze", f"{base}/ckpt")
    assert first["ingested"] == {"odds": odds.count(), "kalshi": quotes.count()}
    again = jobs.job_bronze(spark, landing, f"{base}/bronze", f"{base}/ckpt")
    assert again["ingested"] == {"odds": 0, "kalshi": 0}
    assert {r[0]: r[1] for r in again["tables"].collect()} == {"raw_odds": odds.count(), "raw_kalshi": quotes.count()}
    # the nested Bronze odds flatten like the source
    from linecast.operators.odds import flatten_odds

    assert flatten_odds(jobs.read_feed(spark, f"{base}/bronze", f"{base}/ckpt", "odds")).count() == flatten_odds(odds).count()


def test_shuffle_partitions_follow_input_size(spark):
    from linecast.session import estimated_bytes, size_shuffle_partitions

    prev = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        ev = spark.read.parquet("/root/testdata/sf0.1/events.parquet")
        assert estimated_bytes(ev) > 0
        assert size_shuffle_partitions(spark, ev) == 2 * spark.sparkContext.defaultParallelism
        assert size_shuffle_partitions(spark, ev, target_bytes=64 * 1024) > 2 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", prev)


def test_job_tickers_does_not_deal_games_by_sport(spark):
    sport_dim, team_dim, _ = td.test_dims(spark, SF)
    markets = spark.createDataFrame([], "event_ticker STRING, market_ticker STRING")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # games are too many to be broadcast
    try:
        out = jobs.job_tickers(C.parsed_games(spark, SF), sport_dim, team_dim, markets, order=("seq",))["tickers"]
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert not re.findall(r"hashpartitioning\(\w+#\d+L?, \d+\)", plan)
    assert not out.isEmpty()
