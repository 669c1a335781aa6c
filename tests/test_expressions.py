import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linecast.functions import odds as FO
from linecast.functions import scores as FS
from linecast.functions import text as FT
from linecast.functions import timefn as TF


def _p(o):
    if o is None:
        return None
    return (-o) / (-o + 100) if o < 0 else 100 / (o + 100)


def test_american_to_prob_fixture_rows(spark):
    rows = [(-150,), (130,), (-110,), (-100,), (100,), (0,), (None,)]
    df = spark.createDataFrame(rows, "o BIGINT").select(F.round(FO.american_to_prob("o"), 6).alias("p"))
    assert [r.p for r in df.collect()] == [0.6, 0.434783, 0.52381, 0.5, 0.5, 1.0, None]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(min_value=-100000, max_value=100000), min_size=1, max_size=20))
def test_american_to_prob_matches_python_rule(spark, odds):
    df = spark.createDataFrame([(o,) for o in odds], "o BIGINT").select("o", FO.american_to_prob("o").alias("p"))
    for r in df.collect():
        assert r.p == pytest.approx(_p(r.o))


def test_american_to_prob_properties(spark):
    odds = list(range(100, 3000, 37))
    df = spark.createDataFrame([(o,) for o in odds], "o BIGINT").select(
        "o", FO.american_to_prob("o").alias("pos"), FO.american_to_prob(-F.col("o")).alias("neg")
    )
    rows = df.orderBy("o").collect()
    for r in rows:
        assert 0 < r.pos <= 1 and 0 < r.neg <= 1
        assert r.pos + r.neg == pytest.approx(1.0)
    pos = [r.pos for r in rows]
    assert all(a > b for a, b in zip(pos, pos[1:]))  # longer odds, lower probability


def test_sql_function_inlines(spark):
    FO.register_sql_functions(spark)
    df = spark.sql("SELECT round(american_to_prob(-150), 3) AS a, round(american_to_prob(130), 3) AS b")
    assert tuple(df.first()) == (0.6, 0.435)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan


def test_event_ticker_dates(spark):
    df = spark.createDataFrame([("2026-03-25T00:10Z", "DEN", "PHX")], "t STRING, away STRING, home STRING")
    et = df.select(FT.event_ticker(F.lit("KXNBAGAME"), TF.game_date("t"), "away", "home")).first()[0]
    utc = df.select(FT.event_ticker(F.lit("KXNBAGAME"), TF.game_date("t", "UTC"), "away", "home")).first()[0]
    assert et == "KXNBAGAME-26MAR24DENPHX"
    assert utc == "KXNBAGAME-26MAR25DENPHX"
    bad = spark.createDataFrame([("not a date", "DEN", "PHX")], "t STRING, away STRING, home STRING")
    assert bad.select(FT.event_ticker(F.lit("X"), TF.game_date("t"), "away", "home")).first()[0] is None


def test_suffix_and_series_key(spark):
    df = spark.createDataFrame([("KXNBAGAME-26MAR24DENPHX-DEN", "Denver", "fanduel"), ("plain", "A", "b")], "t STRING, team STRING, book STRING")
    rows = df.select(FT.ticker_suffix("t").alias("s"), FT.series_key("team", "book").alias("k")).collect()
    assert [(r.s, r.k) for r in rows] == [("DEN", "Denver__fanduel"), ("plain", "A__b")]


def test_period_label_and_leader(spark):
    rows = [("basketball_nba", 0, "0", "0"), ("basketball_nba", 3, "50", "48"), ("basketball_nba", 6, "99", "99"),
            ("basketball_ncaab", 2, "", "3"), ("basketball_ncaab", 3, "10x", "9"), ("other", 2, None, "1")]
    df = spark.createDataFrame(rows, "s STRING, p INT, h STRING, a STRING")
    out = df.select(FS.period_label("s", "p").alias("l"), FS.home_winning("h", "a").alias("hw"), FS.away_winning("h", "a").alias("aw")).collect()
    assert [r.l for r in out] == ["", "Q3", "OT2", "H2", "OT1", "P2"]
    assert [(r.hw, r.aw) for r in out] == [(False, False), (True, False), (False, False), (False, True), (True, False), (False, True)]


def test_game_window(spark):
    # 2024-01-04 is a Thursday. Times are UTC; LA is UTC-8 in January.
    rows = [("2024-01-04 17:00:00",), ("2024-01-04 23:00:00",), ("2024-01-05 07:00:00",), ("2024-01-05 07:01:00",), ("2024-01-06 17:00:00",)]
    df = spark.createDataFrame(rows, "t STRING").select(TF.in_game_window(F.col("t").cast("timestamp")).alias("w"))
    # Thu 09:00 early window; Thu 15:00 evening; Thu 23:00 end inclusive; Thu 23:01 out; Sat 09:00 out
    assert [r.w for r in df.collect()] == [True, True, True, False, False]


def test_parse_ts_shapes(spark):
    df = spark.createDataFrame([("2026-03-25T00:10Z",), ("2026-03-25T00:10:00.123456+00:00",), ("junk",)], "s STRING")
    out = [r[0] for r in df.select(TF.parse_ts("s").cast("string")).collect()]
    assert out == ["2026-03-25 00:10:00", "2026-03-25 00:10:00.123456", None]
