import datetime as dt

from pyspark.sql import functions as F

from shelfgap.operators import snapshot as SN
from conftest import rows, text_frame


def test_snapshot_multi_channel(spark):
    wh = text_frame(spark, ["posting_date", "site_code", "location", "article_code",
                            "latest_article_description", "stock_balance"],
                    [("2026-03-01", "1110", "L1", "A1", "Bag", 2), ("2026-03-01", "1110", "L1", "A1", "Bag", 3),
                     ("2026-03-02", "1112", "L2", "A1", "Bag", 1), ("2026-04-01", "1110", "L1", "A1", "Bag", 9),
                     ("2026-03-05", "1110", "L1", "A2", "Belt", 4), ("2026-03-05", "9999", "L9", "A1", "Bag", 4)])
    wh = (wh.withColumn("posting_date", F.to_date("posting_date"))
          .withColumn("stock_balance", F.col("stock_balance").cast("double")))
    sites = SN.channel_sites_from_lists(spark, {"th": ["1110", "1112"], "tht": ["1110"]})
    skus = text_frame(spark, ["SKU Code"], [(" A1 ",), ("A1",), ("",), (None,)])
    snap = SN.stock_snapshot(wh, sites, skus, dt.date(2026, 3, 1), dt.date(2026, 3, 31))
    assert rows(snap, "channel", "posting_date", "site_code", "article_code", "stock_balance") == [
        ("th", dt.date(2026, 3, 1), "1110", "A1", 5.0),
        ("th", dt.date(2026, 3, 2), "1112", "A1", 1.0),
        ("tht", dt.date(2026, 3, 1), "1110", "A1", 5.0),
    ]
    summ = rows(SN.snapshot_summary(snap, sites, skus, "Sheet1", "in/skus", "out"))
    assert summ == [("th", "TH", "Sheet1", 1, 2, 2, "in/skus", "out/channel=th"),
                    ("tht", "THT", "Sheet1", 1, 1, 1, "in/skus", "out/channel=tht")]
