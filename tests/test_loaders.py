"""Loader goldens stated in the reference's own tests (FIXTURES.md §2)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfgap.sources import loaders as L
from conftest import rows, text_frame

MAP_COLS = ["Virtual Location", "Priority", "Site", "Sloc", "Excl. Safety", "Active", "Internal"]


def site_map(spark, data):
    return text_frame(spark, MAP_COLS, [(v, 1, s, 11, None, a, v) for v, s, a in data])


def test_site_map_cn(spark):
    raw = site_map(spark, [("WH-BKK", "1110", "X"), ("WH-BKK-DELIVERY", "1112", "X")])
    out = L.load_site_map(raw, "kingpowercn")
    assert rows(out, "site_code", "virtual_site") == [("1110", "wh-bkk"),
                                                      ("1112", "wh-bkk-delivery")]


def test_site_map_allowed_sites_cn(spark):
    raw = site_map(spark, [("BKK-OUT", "26GA", "X"), ("WH-BKK", "1110", "X"),
                           ("WH-BKK-DELIVERY", "1113", "X"), ("WH-BKK-2", "1110", "X"),
                           ("THT-FREEZONE", "12ZB", "X"), ("WH-ONLINE-DMALL", "12ZC", "X")])
    out = L.load_site_map(raw, "cn")
    assert rows(out, "site_code", "virtual_site") == [("1110", "wh-bkk"), ("1113", "wh-bkk-delivery"),
                                                      ("26GA", "bkk-out")]


def test_site_map_expansion_tht(spark):
    raw = site_map(spark, [("WH-ONLINE-DMALL", "12ZC", "X"), ("WH-ONLINE-JD", "12ZD", "X"),
                           ("WH-ONLINE-THT", "12ZE", "X"), ("WH-ONLINE-TIKTOK", "12ZF", "X"),
                           ("THT-FREEZONE", "12ZB", "X"), ("JD-FREEZONE", "12ZG", "X"),
                           ("BKK-OUT", "26GA", "X")])
    out = rows(L.load_site_map(raw, "tht"), "site_code", "virtual_site")
    sites = {v for _, v in out}
    assert len(sites) == 8
    assert ("12ZC", "dmall-online-wh") in out and ("12ZD", "jd-online-wh") in out
    assert "bkk-out" not in sites


def test_site_map_inactive_and_blank_rows(spark):
    raw = site_map(spark, [("WH-BKK", "1110", " x "), ("BKK-OUT", "26GA", ""),
                           ("DMK-OUT", " ", "X"), (None, "27AA", "X"), ("WH-BKK", "1110.0", "X")])
    out = L.load_site_map(raw, "th")
    assert rows(out, "site_code", "virtual_site") == [("1110", "wh-bkk")]


def test_orders_cn_sheet(spark):
    raw = text_frame(spark, ["DATE", "ORDER NO", "SKU", "DESCRIPTION", "QTY", "GROSS", "NET",
                             "Storage Location"],
                     [("01.02.2026", "ORDER-1", "SKU-1", "Bag", "2", "100", "90", "WH-BKK"),
                      ("15.02.2026", "ORDER-2", "SKU-2", "Watch", "4", "200", "180",
                       "WH-BKK-DELIVERY")])
    out = L.load_orders(raw, "kingpowercn").orderBy("sku").collect()
    assert [r["stock_code"] for r in out] == ["wh-bkk", "wh-bkk-delivery"]
    assert [r["quantity"] for r in out] == [2.0, 4.0]
    assert [r["net"] for r in out] == [90.0, 180.0]
    assert [r["purchase_date"].date() for r in out] == [dt.date(2026, 2, 1), dt.date(2026, 2, 15)]


def test_orders_th_drops_bad_rows(spark):
    raw = text_frame(spark, ["Purchase Date", "Sku", "stock", "Quantity", "Gross", "Net",
                             "Product Name"],
                     [("2026-02-01", "SKU-1", " WH-BKK-2 ", "1,002", "100", "90", "Bag"),
                      ("not a date", "SKU-2", "bkk-out", "1", "1", "1", "x"),
                      ("2026-02-03", "  ", "bkk-out", "1", "1", "1", "x"),
                      ("2026-02-04", "p77", "bkk-out", "x", "1", "1", "x")])
    out = rows(L.load_orders(raw, "th"), "sku", "stock_code", "quantity", "excluded_prefix_p")
    assert out == [("SKU-1", "wh-bkk", 1002.0, False), ("p77", "bkk-out", 0.0, True)]


def test_orders_missing_columns(spark):
    raw = text_frame(spark, ["Purchase Date", "Sku", "stock", "Quantity"], [])
    with pytest.raises(ValueError, match="required columns are missing"):
        L.load_orders(raw, "th")


def test_ranked_product_merge(spark):
    cols = ["SKU CODE", "DESCRIPTION", "商品名称", "WEB STATUS"]
    cc = text_frame(spark, cols, [("SKU-1", "Bag", "Bag CN", "HIDE"),
                                  ("SKU-2", "Watch", "Watch CN", "LIVE")])
    hd = text_frame(spark, cols, [("SKU-1", "Bag", "Bag CN HD", "LIVE"),
                                  ("SKU-3", "Wallet", "Wallet CN", "LIVE")])
    out = L.load_products({"click&collect": cc, "HomeDelivery": hd}, "kingpowercn")
    assert rows(out) == [("SKU-1", "Bag CN HD", "live", False),
                         ("SKU-2", "Watch CN", "live", False),
                         ("SKU-3", "Wallet CN", "live", False)]


def test_ranked_merge_tie_breaks(spark):
    cols = ["SKU CODE", "DESCRIPTION", "WEB STATUS"]
    a = text_frame(spark, cols, [("K1", "", "live"), ("K2", "name a", "hide")])
    b = text_frame(spark, cols, [("K1", "named", "live"), ("K2", "name b", "hide")])
    out = L.merge_ranked_products({"b_sheet": b, "a_sheet": a})
    # K1: same status, the row with a name wins; K2: full tie -> first sheet name
    assert rows(out, "sku", "product_name") == [("K1", "named"), ("K2", "name a")]


def test_product_missing_sheet(spark):
    cols = ["SKU CODE", "DESCRIPTION", "WEB STATUS"]
    with pytest.raises(ValueError, match="missing sheets"):
        L.load_products({"click&collect": text_frame(spark, cols, [])}, "kingpowercn")


def test_product_first_row_wins(spark):
    raw = text_frame(spark, ["skuNo", "productName", "status", "row_ord"],
                     [("K1", "first", "Live", 1), ("K1", "second", "hide", 2),
                      ("=\"K2\"", "x", None, 3)]).withColumn("row_ord", F.col("row_ord").cast("long"))
    out = L.load_product_list(raw)
    assert rows(out) == [("K1", "first", "live", False), ("K2", "x", None, False)]


def test_append_orders_distinct(spark):
    raw = text_frame(spark, ["Purchase Date", "Sku", "stock", "Quantity", "Gross", "Net",
                             "Product Name"],
                     [("2026-01-01", "K1", "a", "1", "1", "1", "x"),
                      ("2026-02-01", "K1", "a", "2", "2", "2", "x")])
    o = L.load_orders(raw, "th")
    hist = o.filter(F.col("purchase_date") < "2026-03-01")
    cur = o.filter(F.col("purchase_date") >= "2026-02-01")
    assert L.append_orders(hist, cur).count() == 2


def test_daily_stock_loader(spark):
    raw = text_frame(spark, ["posting_date", "site_code", "article_code", "stock_balance"],
                     [("2026-02-01", "1110.0", "SKU-1", "5"), ("2026-02-15", "DMK", "SKU-2", "1,7"),
                      ("bad", "DMK", "SKU-2", "1")])
    out = rows(L.load_daily_stock(raw), "posting_date", "site_code", "sku", "stock_balance",
               "location")
    assert out == [(dt.date(2026, 2, 1), "1110", "SKU-1", 5.0, ""),
                   (dt.date(2026, 2, 15), "DMK", "SKU-2", 0.0, "")]
