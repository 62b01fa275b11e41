"""Edge cases named in SURVEY §7.5: site fan-out and an empty detail."""

from shelfgap.operators import model as M
from shelfgap.operators import reports as R
from shelfgap.profiles import ModelConfig
from shelfgap.sources import loaders as L
from conftest import rows, text_frame

CFG = ModelConfig(eval_year=2026, eval_month=2)


def test_site_fan_out_counts_stock_in_every_virtual_site(spark):
    site_map = text_frame(spark, ["Virtual Location", "Site", "Active"],
                          [("WH-BKK", "1110", "X"), ("BKK-OUT", "1110", "X"),
                           ("DMK-OUT", "2220", "X")])
    product = text_frame(spark, ["skuNo", "productName", "status"], [("K1", "Bag", "live")])
    stock = text_frame(spark, ["posting_date", "site_code", "article_code", "stock_balance"],
                       [("2026-02-01", "1110", "K1", "2"), ("2026-02-02", "1110", "K1", "0"),
                        ("2026-02-01", "2220", "K1", "-1")])
    orders = text_frame(spark, ["Purchase Date", "Sku", "stock", "Quantity", "Gross", "Net",
                                "Product Name"], [])
    inputs = M.ModelInputs(product=L.load_products(product, "th"),
                           orders=L.load_orders(orders, "th"),
                           stock=L.load_daily_stock(stock), site_map=L.load_site_map(site_map, "th"))
    d = M.loss_detail(inputs, CFG).drop("channel")
    assert rows(d, "virtual_site", "recorded_days", "in_stock_days", "oos_days_jan") == [
        ("bkk-out", 2, 1, 27), ("dmk-out", 1, 0, 28), ("wh-bkk", 2, 1, 27)]
    # no order history at all: prices 0, no loss, no-history labels
    assert rows(d, "baseline_source", "gross_per_unit", "loss_net") == [("no_history", 0.0, 0.0)] * 3


def test_empty_detail_example(spark):
    from pyspark.sql import functions as F
    site_map = text_frame(spark, ["Virtual Location", "Site", "Active"], [("WH-BKK", "1110", "X")])
    product = text_frame(spark, ["skuNo", "productName", "status"], [("K1", "Bag", "live")])
    stock = text_frame(spark, ["posting_date", "site_code", "article_code", "stock_balance"], [])
    orders = text_frame(spark, ["Purchase Date", "Sku", "stock", "Quantity", "Gross", "Net",
                                "Product Name"], [])
    inputs = M.ModelInputs(product=L.load_products(product, "th"),
                           orders=L.load_orders(orders, "th"),
                           stock=L.load_daily_stock(stock), site_map=L.load_site_map(site_map, "th"))
    empty = M.loss_detail(inputs, CFG).drop("channel").filter(F.lit(False))
    out = R.calculation_example(empty).collect()
    assert [(r["item"], r["value"]) for r in out] == [("No sample row", "Detail sheet is empty")]
    assert rows(R.summary_total(empty), "metric", "value") == [
        ("Total Lost Qty Raw", 0.0), ("Total Lost Value Gross Raw", 0.0),
        ("Total Lost Value Net Raw", 0.0)]
