"""Hand-derived golden for the loss model (FIXTURES.md §3): month 2026-02."""

import pytest

from shelfgap.operators import model as M
from shelfgap.operators import quality as Q
from shelfgap.operators import reports as R
from shelfgap.operators import stock as K
from shelfgap.profiles import ModelConfig
from shelfgap.sources import loaders as L
from conftest import rows, text_frame

CFG = ModelConfig(eval_year=2026, eval_month=2)


@pytest.fixture(scope="module")
def inputs(spark):
    site_map = text_frame(spark, ["Virtual Location", "Site", "Active"],
                          [("WH-BKK", "1110", "X"), ("BKK-OUT", "26GA", "X")])
    product = text_frame(spark, ["skuNo", "productName", "status"],
                         [("K1", "Bag", "live"), ("K2", "Watch", "live"), ("K3", "Belt", "live"),
                          ("K4", "Pen", "hide"), ("P9", "Promo", "live")])
    stock_rows = [(f"2026-02-{d:02d}", "1110", "K1", "5") for d in range(1, 11)]
    stock_rows += [("2026-02-11", "1110", "K1", "0"), ("2026-02-12", "1110", "K1", "0"),
                   ("2026-02-12", "ZZZZ", "K1", "3"),
                   ("2026-01-31", "1110", "K2", "9")]          # outside the month
    stock = text_frame(spark, ["posting_date", "site_code", "article_code", "stock_balance"],
                       stock_rows)
    orders = text_frame(spark, ["Purchase Date", "Sku", "stock", "Quantity", "Gross", "Net",
                                "Product Name"],
                        [("2025-10-10", "K1", "WH-BKK", "92", "1104", "920", "Bag"),
                         ("2025-09-01", "K2", "WH-BKK", "5", "110", "100", "Watch"),
                         ("2025-09-02", "K2", "WH-BKK", "-5", "-110", "-100", "Watch"),
                         ("2025-03-01", "K2", "WH-BKK", "181", "3982", "3620", "Watch"),
                         ("2026-02-05", "K2", "WH-BKK", "3", "66", "60", "Watch")])
    return M.ModelInputs(product=L.load_products(product, "th"), orders=L.load_orders(orders, "th"),
                         stock=L.load_daily_stock(stock), site_map=L.load_site_map(site_map, "th"))


@pytest.fixture(scope="module")
def detail(inputs):
    return M.loss_detail(inputs, CFG).drop("channel").cache()


def test_detail_rows(detail):
    got = rows(detail, "sku", "virtual_site", "recorded_days", "in_stock_days", "oos_days_jan",
               "baseline_source", "baseline_daily_qty", "expected_qty_jan", "actual_qty_jan",
               "qty_gap_jan", "lost_qty_raw", "loss_gross", "loss_net")
    assert got == [
        ("K1", "bkk-out", 0, 0, 28, "no_history", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
        ("K1", "wh-bkk", 12, 10, 18, "recent_6m", 0.5, 14.0, 0.0, 14.0, 9.0, 108.0, 90.0),
        ("K2", "bkk-out", 0, 0, 28, "no_history", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
        ("K2", "wh-bkk", 0, 0, 28, "fallback_prev_6m", 1.0, 28.0, 3.0, 25.0, 0.0, 0.0, 0.0),
        ("K3", "bkk-out", 0, 0, 28, "no_history", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
        ("K3", "wh-bkk", 0, 0, 28, "no_history", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    ]


def test_golden_exact(detail):
    # sales are per stock code, so bkk-out has no history for any sku
    got = {(r["sku"], r["virtual_site"]): r for r in detail.collect()}
    assert len(got) == 6
    k1 = got[("K1", "wh-bkk")]
    assert (k1["baseline_window_start"], k1["baseline_window_end"], k1["baseline_window_days"]) == (
        "2025-08-01", "2026-01-31", 184)
    assert (k1["gross_per_unit"], k1["net_per_unit"]) == (12.0, 10.0)
    assert (k1["lost_qty"], k1["loss_gross"], k1["loss_net"]) == (9.0, 108.0, 90.0)
    k2 = got[("K2", "wh-bkk")]
    assert (k2["recent_qty"], k2["fallback_qty"], k2["baseline_window_days"]) == (0.0, 181.0, 181)
    assert (k2["baseline_window_start"], k2["baseline_window_end"]) == ("2025-02-01", "2025-07-31")
    assert (k2["gross_per_unit"], k2["net_per_unit"]) == (22.0, 20.0)
    assert k2["is_actual_zero_jan"] is False and k2["lost_qty_raw"] == 0.0
    for key in [("K1", "bkk-out"), ("K2", "bkk-out"), ("K3", "bkk-out"), ("K3", "wh-bkk")]:
        r = got[key]
        assert (r["baseline_source"], r["oos_days_jan"], r["loss_net"]) == ("no_history", 28, 0.0)
        assert (r["baseline_window_start"], r["baseline_window_days"]) == ("", 0)
    assert all(r["baseline_method"] == "rolling_6m_with_6m_fallback" for r in got.values())
    assert all(r["observed_days_jan"] == 28 for r in got.values())
    assert got[("K1", "wh-bkk")]["product_name"] == "Bag"


def test_reports(detail):
    total = dict(rows(R.summary_total(detail)))
    assert total == {"Total Lost Qty Raw": 9.0, "Total Lost Value Gross Raw": 108.0,
                     "Total Lost Value Net Raw": 90.0}
    site = {r["virtual_site"]: r for r in R.summary_site(detail).collect()}
    assert site["wh-bkk"]["avg_oos_ratio"] == pytest.approx(74 / 84)
    assert site["bkk-out"]["avg_oos_ratio"] == 1.0
    assert site["wh-bkk"]["sku_site_rows_eval"] == 3
    sku = {r["sku"]: r for r in R.summary_sku(detail, ["bkk-out", "wh-bkk"]).collect()}
    assert sku["K1"]["loss_net_wh-bkk"] == 90.0 and sku["K1"]["loss_net_bkk-out"] == 0.0
    ex = R.calculation_example(detail).orderBy("seq").collect()
    assert len(ex) == 17
    assert ex[0]["value"] == "SKU K1 | Site wh-bkk"
    assert ex[15]["item"] == "Step 5 loss_net" and float(ex[15]["value"]) == 90.0


def test_unmapped_and_qa(inputs, detail):
    assert rows(K.unmapped_sites(inputs.stock, inputs.site_map, CFG)) == [("ZZZZ", 1)]
    qa = {r["metric"]: r["value"] for r in Q.qa_summary(inputs, CFG, detail=detail).collect()}
    assert len(qa) == 20
    assert qa["product_sku_count_all"] == 5
    assert qa["product_sku_count_excl_prefix_p"] == 4
    assert qa["sku_universe_count"] == 3
    assert qa["daily_stock_rows_eval_month"] == 12
    assert qa["unmapped_site_code_count"] == 1
    assert qa["detail_rows"] == 6
    assert qa["detail_rows_baseline_recent"] == 1
    assert qa["detail_rows_baseline_fallback"] == 1
    assert qa["detail_rows_actual_gt_zero"] == 1
    assert qa["total_lost_value_net_raw"] == 90.0
    assert qa["excluded_prefix_p_products"] == 1
