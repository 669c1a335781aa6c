from pyspark.sql import functions as F

from linecast.operators import boards as B
from linecast.operators import dims as D
from linecast.operators import serving as S
from linecast.plans import testdata as td

SIG = "sport_key STRING, home_team STRING, away_team STRING, computed_at TIMESTAMP, divergence DOUBLE, market_ticker STRING, commence_time TIMESTAMP, signal_direction STRING"


def _sig(spark, rows):
    return spark.createDataFrame(rows, SIG)


def test_latest_batch_uses_max_before_sport_filter(spark):
    import datetime as dt

    t1, t2 = dt.datetime(2026, 3, 24, 20, 0), dt.datetime(2026, 3, 24, 20, 2)
    df = _sig(spark, [("basketball_nba", "H", "A", t1, 0.1, "M-H", t1, "x"), ("basketball_wncaab", "H2", "A2", t2, 0.2, "M-H2", t1, "x")])
    # The latest batch belongs to an excluded sport, so nothing is left (quirk Q6).
    assert S.latest_batch(df).count() == 0
    assert S.latest_batch(df, exclude=None).count() == 1


def test_exclude_womens_drops_null_sport(spark):
    df = _sig(spark, [(None, "H", "A", None, 0.1, "M", None, "x"), ("basketball_nba", "H", "A", None, 0.1, "M", None, "x")])
    assert S.exclude_womens(df).count() == 1


def test_tournament_only(spark):
    df = _sig(spark, [
        ("basketball_ncaab", "Duke", "UNC", None, 0.1, "M", None, "x"),
        ("basketball_ncaab", "Duke", "Nobody", None, 0.1, "M", None, "x"),
        ("basketball_nba", "Nobody", "Nobody", None, 0.1, "M", None, "x"),
        (None, "Nobody", "Nobody", None, 0.1, "M", None, "x"),
    ])
    teams = spark.createDataFrame([("Duke",), ("UNC",)], "team STRING")
    got = sorted((r.sport_key or "", r.away_team) for r in S.tournament_only(df, teams).collect())
    assert got == [("", "Nobody"), ("basketball_nba", "Nobody"), ("basketball_ncaab", "UNC")]


def test_schedule_end_inclusive_unlisted_day_and_always_on(spark):
    sport_dim, _, sched = D.load_dims(D.config_from_dict(spark, td.TEST_CONFIG))
    # 2024-01-04 is Thursday, 2024-01-08 Monday; Chicago = UTC-6.
    rows = [
        ("basketball_nba", "2024-01-05 04:40:00"),   # Thu 22:40 local: end minute -> in
        ("basketball_nba", "2024-01-05 04:41:00"),   # Thu 22:41 -> out
        ("basketball_ncaab", "2024-01-09 00:00:00"),  # Mon 18:00, Monday not listed -> out
        ("basketball_wncaab", "2024-01-07 12:00:00"),  # no schedule -> in
        ("unknown_sport", "2024-01-07 23:00:00"),      # not configured -> out
    ]
    df = spark.createDataFrame(rows, "sport_key STRING, t STRING").withColumn("t", F.col("t").cast("timestamp"))
    got = [r.in_schedule for r in D.in_schedule(df, "t", sport_dim, sched).orderBy("t", "sport_key").collect()]
    by_row = {(r.sport_key, str(r.t)): r.in_schedule for r in D.in_schedule(df, "t", sport_dim, sched).collect()}
    assert by_row[("basketball_nba", "2024-01-05 04:40:00")] is True
    assert by_row[("basketball_nba", "2024-01-05 04:41:00")] is False
    assert by_row[("basketball_ncaab", "2024-01-09 00:00:00")] is False
    assert by_row[("basketball_wncaab", "2024-01-07 12:00:00")] is True
    assert by_row[("unknown_sport", "2024-01-07 23:00:00")] is False
    assert len(got) == 5
    assert sorted(r.sport_key for r in D.active_sports(sport_dim).collect()) == ["basketball_nba", "basketball_ncaab"]


def test_board_order_missing_score_last(spark):
    import datetime as dt

    t = dt.datetime(2026, 3, 24, 20, 0)
    board = spark.createDataFrame(
        [("A1|H1", "A1", "H1", t, 5.0), ("A2|H2", "A2", "H2", t.replace(hour=22), 9.0), ("A3|H3", "A3", "H3", t.replace(hour=21), 1.0),
         ("A4|H4", "A4", "H4", t, 7.0)],
        "game_key STRING, away_team STRING, home_team STRING, commence_time TIMESTAMP, v DOUBLE",
    )
    sb = spark.createDataFrame([("A1", "H1", "post"), ("A2", "H2", "pre"), ("A3", "H3", "pre"), ("A4", "H4", "in")], "away_team STRING, home_team STRING, state STRING")
    board = board.unionByName(spark.createDataFrame([("A5|H5", "A5", "H5", t, 100.0)], board.schema))
    order = [r.game_key for r in B.board_order(board, sb, "v").collect()]
    assert order == ["A4|H4", "A3|H3", "A2|H2", "A5|H5", "A1|H1"]


def test_bar_share_floor_one(spark):
    b = spark.createDataFrame([("g1", 0.5), ("g2", 0.25)], "game_key STRING, v DOUBLE")
    assert [r.bar_share for r in B.bars_desc(b, "v").collect()] == [0.5, 0.25]


def test_scoreboard_latest_later_entry_wins(spark):
    ev = td.scoreboard_events(spark, "/root/testdata/sf0.001")
    latest = B.scoreboard_latest(ev, order_cols=("seq",), keep=("sport_key",))
    assert latest.count() == latest.select("game_key").distinct().count()


def test_pivot_wide_from_long(spark):
    import datetime as dt

    t = dt.datetime(2026, 3, 24, 20, 0, 30)
    hist = spark.createDataFrame(
        [("H", "A", "EV-H", t, 0.6, 0.55), ("H", "A", "EV-H", t.replace(second=50), 0.62, 0.56), ("H", "A", "EV-A", t, 0.4, 0.55)],
        "home_team STRING, away_team STRING, market_ticker STRING, computed_at TIMESTAMP, kalshi_implied_prob DOUBLE, sportsbook_home_prob DOUBLE",
    )
    wide = B.pivot_wide(B.pivot_divergence_long(hist), series=["kalshi_H", "kalshi_A", "sportsbook_avg"]).collect()
    assert len(wide) == 1
    r = wide[0]
    assert (r.kalshi_H, r.kalshi_A, r.sportsbook_avg) == (0.62, 0.4, 0.56)


def test_latest_dedup_window_and_latest_row(spark):
    import datetime as dt

    t = dt.datetime(2026, 3, 24, 20, 0)
    rows = [
        ("basketball_nba", "H", "A", t, 0.10, "M-H", t, "x"),
        ("basketball_nba", "H", "A", t + dt.timedelta(minutes=25), 0.20, "M-H", t, "x"),
        ("basketball_nba", "H", "A", t + dt.timedelta(minutes=30), 0.30, "M-H", t, "x"),
        ("basketball_nba", "H2", "A2", t + dt.timedelta(minutes=15), 0.40, "M-H2", t, "x"),  # older than max - 10 min
        ("basketball_wncaab", "H3", "A3", t + dt.timedelta(minutes=30), 0.50, "M-H3", t, "x"),
    ]
    got = S.latest_dedup(_sig(spark, rows), S.DIVERGENCE_SERIES).collect()
    assert [(r.market_ticker, r.divergence) for r in got] == [("M-H", 0.30)]


def test_attach_abbr_falls_back_to_name(spark):
    from linecast.operators.joins import attach_abbr

    df = spark.createDataFrame([("Denver Nuggets",), ("Nowhere",)], "away_team STRING")
    dim = spark.createDataFrame([("dash", "basketball_nba", "Denver Nuggets", "DEN")], "source STRING, sport_key STRING, team STRING, abbr STRING")
    assert sorted(r.a for r in attach_abbr(df, dim, "away_team", "a").collect()) == ["DEN", "Nowhere"]


def test_feed_orders_nulls_last_and_limits(spark):
    df = _sig(spark, [("basketball_nba", f"H{i}", "A", None, d, "M", None, "x") for i, d in enumerate([0.1, None, 0.3, 0.2])])
    got = [r.divergence for r in S.feed(df, "divergence", limit=3).collect()]
    assert got == [0.3, 0.2, 0.1]


def test_recent_hours_none_keeps_all(spark):
    import datetime as dt

    df = _sig(spark, [("basketball_nba", "H", "A", dt.datetime(2020, 1, 1), 0.1, "M", None, "x")])
    assert S.recent_hours(df, None, "2026-01-01 00:00:00").count() == 1
    assert S.recent_hours(df, 1, "2026-01-01 00:00:00").count() == 0


def test_aliases_restore_the_join(spark):
    from linecast.operators.joins import apply_aliases, unmatched_teams

    games = spark.createDataFrame([("basketball_ncaab", "Michigan St", "Duke")], "sport_key STRING, home_team STRING, away_team STRING")
    dim = spark.createDataFrame(
        [("tickers", "basketball_ncaab", "Michigan State", "MSU"), ("tickers", "basketball_ncaab", "Duke", "DUKE")],
        "source STRING, sport_key STRING, team STRING, abbr STRING",
    )
    assert [r.team for r in unmatched_teams(games, dim).collect()] == ["Michigan St"]
    aliases = spark.createDataFrame([("Michigan St", "Michigan State")], "alias STRING, team STRING")
    fixed = apply_aliases(games, aliases)
    assert fixed.first().home_team == "Michigan State"
    assert unmatched_teams(fixed, dim).count() == 0
