"""Validation findings, profiles and month suggestion (FIXTURES.md §2, I4/E16/E17)."""

import datetime as dt

from shelfgap.operators import quality as Q
from shelfgap.operators import sitemap as SM
from shelfgap.sources import loaders as L
from conftest import rows, text_frame

SALES = ["Purchase Date", "Sku", "stock", "Quantity", "Gross", "Net", "Product Name"]
STOCK = ["posting_date", "site_code", "article_code", "stock_balance"]


def codes(df):
    return rows(df, "dataset", "severity", "code")


def test_missing_columns(spark):
    raw = {"sales": text_frame(spark, ["Purchase Date", "Sku", "stock", "Quantity"], []),
           "stock": text_frame(spark, ["posting_date", "site_code"], []),
           "sku_live": text_frame(spark, ["productName"], [])}
    out = Q.input_findings(raw, "th")
    assert codes(out) == [("sales", "error", "missing_required_columns"),
                          ("sku_live", "error", "missing_required_columns"),
                          ("stock", "error", "missing_required_columns")]
    msg = {r["dataset"]: r["message"] for r in out.collect()}
    assert msg["sales"] == "Missing required columns: Gross, Net, Product Name"


def test_profile_and_no_warnings(spark):
    sales = text_frame(spark, SALES, [("2026-02-01", "SKU-1", "bkk-out", 2, 100, 90, "Bag"),
                                      ("2026-02-28", "SKU-2", "dmk-out", 4, 200, 180, "Watch")])
    prof = Q.input_profile("sales", sales, "th").first()
    assert (prof["row_count"], prof["min_date"], prof["max_date"], prof["month_hints"]) == (
        2, dt.date(2026, 2, 1), dt.date(2026, 2, 28), "2026-02")
    assert Q.input_findings({"sales": sales}, "th").count() == 0


def test_warnings(spark):
    empty = text_frame(spark, STOCK, [])
    two_months = text_frame(spark, STOCK, [("2026-02-01", "BKK", "SKU-1", 5),
                                           ("2026-03-01", "BKK", "SKU-1", 5)])
    one_row = text_frame(spark, STOCK, [("2026-02-01", "BKK", "SKU-1", 5)])
    assert codes(Q.dataset_findings("stock", empty, "th")) == [
        ("stock", "warning", "empty_dataset")]
    assert codes(Q.dataset_findings("stock", two_months, "th")) == [
        ("stock", "warning", "multiple_month_hints")]
    assert codes(Q.dataset_findings("stock", one_row, "th")) == [
        ("stock", "warning", "near_empty_dataset")]


def test_site_map_channel_rows(spark):
    raw = text_frame(spark, ["Virtual Location", "Site", "Active"],
                     [("BKK-OUT", "26GA", "X"), ("WH-BKK", "1110", "X")])
    assert codes(Q.dataset_findings("site_mapping", raw, "tht")) == [
        ("site_mapping", "error", "site_mapping_no_channel_rows")]
    assert codes(Q.dataset_findings("site_mapping", raw, "th")) == []
    inactive = text_frame(spark, ["Virtual Location", "Site", "Active"], [("WH-BKK", "1110", "")])
    assert codes(Q.dataset_findings("site_mapping", inactive, "th")) == [
        ("site_mapping", "error", "site_mapping_no_active_rows")]


def test_quality_gate(spark):
    raw = {"sales": text_frame(spark, ["Sku"], []),
           "stock": text_frame(spark, STOCK, [("2026-02-01", "BKK", "SKU-1", 5)])}
    gate = {r["dataset"]: r for r in Q.quality_gate(Q.input_findings(raw, "th"),
                                                    list(raw)).collect()}
    assert (gate["sales"]["error_count"], gate["sales"]["is_ready"]) == (1, False)
    assert (gate["stock"]["warning_count"], gate["stock"]["is_ready"]) == (1, True)
    assert (gate["ALL"]["error_count"], gate["ALL"]["is_ready"]) == (1, False)


def test_month_suggestion(spark):
    one = L.load_daily_stock(text_frame(spark, STOCK, [("2026-02-01", "B", "S", 1),
                                                       ("2026-02-14", "B", "S", 1),
                                                       ("2026-02-28", "B", "S", 1)]))
    r = Q.month_suggestion(one).first()
    assert (r["eval_year"], r["eval_month"], r["is_confident"]) == (2026, 2, True)
    two = L.load_daily_stock(text_frame(spark, STOCK, [("2026-02-28", "B", "S", 1),
                                                       ("2026-03-01", "B", "S", 1)]))
    r = Q.month_suggestion(two).first()
    assert (r["eval_year"], r["is_confident"], r["month_hints"]) == (None, False, "2026-02,2026-03")
    none = L.load_daily_stock(text_frame(spark, STOCK, []))
    r = Q.month_suggestion(none).first()
    assert r["is_confident"] is False and "did not contain" in r["reason"]


def test_site_map_status(spark):
    raw = text_frame(spark, ["Virtual Location", "Site", "Active"],
                     [("WH-BKK", "1110", "X"), ("BKK-OUT", "26GA", "X"), ("WH-BKK", "1111", "X")])
    r = SM.site_map_status(L.load_site_map(raw, "th")).first()
    assert (r["active_mapping_rows"], r["site_count"], r["virtual_site_count"],
            r["sample_virtual_sites"]) == (3, 3, 2, "bkk-out,wh-bkk")


def test_fingerprint_changes(spark):
    a = text_frame(spark, STOCK, [("2026-02-01", "B", "S", 1), ("2026-02-02", "B", "S", 1)])
    b = text_frame(spark, STOCK, [("2026-02-02", "B", "S", 1), ("2026-02-01", "B", "S", 1)])
    c = text_frame(spark, STOCK, [("2026-02-01", "B", "S", 1), ("2026-02-01", "B", "S", 1)])
    fa, fb, fc = (Q.fingerprint(x, "stock") for x in (a, b, c))
    assert rows(fa) == rows(fb)                       # order does not matter
    assert rows(Q.changed_inputs(fa, fc), "changed") == [(True,)]
    assert rows(Q.changed_inputs(fa, fb), "changed") == [(False,)]


def test_overview_staleness(spark):
    from shelfgap.operators import reports as R
    detail = spark.createDataFrame(
        [("K1", "a", 30, 10, 1.0, 2.0, 3.0, 1.0, 2.0, 3.0)],
        "sku string, virtual_site string, observed_days_jan int, oos_days_jan int, "
        "lost_qty_raw double, lost_value_gross_raw double, lost_value_net_raw double, "
        "lost_qty double, loss_gross double, loss_net double")
    qa = spark.createDataFrame([(1, "m", 1.0)], "seq int, metric string, value double")
    unmapped = spark.createDataFrame([("Z", 2)], "site_code string, rows long")
    findings = spark.createDataFrame([], Q.FINDING_SCHEMA)
    a = text_frame(spark, STOCK, [("2026-02-01", "B", "S", 1)])
    b = text_frame(spark, STOCK, [("2026-02-02", "B", "S", 1)])
    same = Q.changed_inputs(Q.fingerprint(a, "stock"), Q.fingerprint(a, "stock"))
    diff = Q.changed_inputs(Q.fingerprint(b, "stock"), Q.fingerprint(a, "stock"))
    r = Q.overview(detail, qa, unmapped, findings, "2026-02", changes=same).first()
    assert (r["is_current"], r["trust_reasons"]) == (True, "1 unmapped site row(s)")
    r = Q.overview(detail, qa, unmapped, findings, "2026-02", changes=diff).first()
    assert r["is_current"] is False
    assert r["trust_reasons"].endswith("staged inputs changed after the last successful run")
    assert r["total_lost_value_net_raw"] == 3.0 and r["detail_row_count"] == 1
