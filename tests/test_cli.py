import tempfile

from pyspark.sql import functions as F

from linecast.__main__ import main
from linecast.plans import testdata as td

SF = "/root/testdata/sf0.001"
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def test_cli_end_to_end(spark, capsys):
    base = tempfile.mkdtemp(prefix="lc-cli-")
    td.raw_odds(spark, SF).drop("event_id").withColumn("ingested_at", F.date_format("ingested_at", ISO)).write.json(f"{base}/landing/odds")
    td.raw_quotes(spark, SF).drop("event_id").withColumn("ingested_at", F.date_format("ingested_at", ISO)).write.json(f"{base}/landing/kalshi")
    main(["bronze", "--landing", f"odds={base}/landing/odds", f"kalshi={base}/landing/kalshi", "--out", f"{base}/bronze"])
    # Default books (none in the test data): an empty sharp table must still read back.
    main(["signals", "--odds", f"{base}/bronze/odds", "--quotes", f"{base}/bronze/kalshi", "--out", f"{base}/empty"])
    assert '["sharp_money_signals", 0, 0]' in capsys.readouterr().out
    main(["history", "--signals", f"{base}/empty", "--out", f"{base}/empty_wh"])
    assert spark.read.parquet(f"{base}/empty_wh/clean/sharp").count() == 0
    main(["feed", "--table", f"{base}/empty/silver/sharp_money_signals", "--order", "prob_movement", "--out", f"{base}/empty_feed"])
    main(["signals", "--odds", f"{base}/bronze/odds", "--quotes", f"{base}/bronze/kalshi", "--out", f"{base}/signals",
          "--sharp-books", *td.TEST_BOOKS, "--segment-seconds", "auto"])
    out = capsys.readouterr().out
    assert '"counts"' in out
    main(["history", "--signals", f"{base}/signals", "--out", f"{base}/warehouse"])
    assert spark.read.parquet(f"{base}/warehouse/clean/sharp").count() > 0
    main(["feed", "--table", f"{base}/signals/silver/sharp_money_signals", "--order", "prob_movement", "--out", f"{base}/feed"])
    assert spark.read.json(f"{base}/feed").count() > 0
    main(["game", "--table", f"{base}/signals/silver/sharp_money_signals", "--kind", "odds", "--home", "H1", "--away", "A1", "--out", f"{base}/game"])
    g = spark.read.json(f"{base}/game")
    assert g.count() > 0 and {r.home_team for r in g.select("home_team").distinct().collect()} == {"H1"}
