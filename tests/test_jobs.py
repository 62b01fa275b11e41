"""File-driven runs: UTF-16 order export, CSV inputs, workbook folders, sinks."""

import datetime as dt
import os

from pyspark.sql import functions as F

from shelfgap.plans.jobs import InputPaths, load_inputs, run_from_paths
from shelfgap.plans.snapshot_job import run_snapshot_job
from shelfgap.operators import snapshot as SN
from shelfgap.profiles import ModelConfig
from shelfgap.sources import readers as RD
from conftest import rows


def write(path, text, encoding="utf-8"):
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(text)


def th_files(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    write(d / "orders.tsv",
          "Purchase Date\tSku\tstock\tQuantity\tGross\tNet\tProduct Name\n"
          "2025-10-10\tK1\tWH-BKK\t92\t1,104\t920\tกระเป๋า\n"
          "2026-02-05\tK2\tWH-BKK\t3\t66\t60\tWatch\n", encoding="utf-16")
    write(d / "orders_actual.tsv",
          "Purchase Date\tSku\tstock\tQuantity\tGross\tNet\tProduct Name\n"
          "2026-02-05\tK2\tWH-BKK\t3\t66\t60\tWatch\n"
          "2026-02-06\tK1\tWH-BKK\t1\t12\t10\tกระเป๋า\n", encoding="utf-16")
    write(d / "stock.csv", "posting_date,site_code,article_code,stock_balance\n"
          "2026-02-01,1110,K1,5\n2026-02-02,1110,K1,0\n2026-02-02,ZZZZ,K1,1\n")
    write(d / "site.csv", "Virtual Location,Priority,Site,Sloc,Excl. Safety,Active,Internal\n"
          "WH-BKK,1,1110,11,,X,WH-BKK\nBKK-OUT,1,26GA,11,,X,BKK-OUT\nDMK-OUT,1,27AA,11,,,DMK\n")
    write(d / "product.csv", "skuNo,productName,status\nK1,,Live\nK2,Watch,live\nP9,Promo,live\n")
    return d


def test_utf16_export_reader(spark, tmp_path):
    d = th_files(tmp_path)
    df = RD.read_orders_export(spark, str(d / "orders.tsv"))
    got = rows(df, "Sku", "Gross", "Product Name")
    assert got == [("K1", "1,104", "กระเป๋า"), ("K2", "66", "Watch")]


def test_run_from_paths_with_append(spark, tmp_path):
    d = th_files(tmp_path)
    paths = InputPaths(orders=str(d / "orders.tsv"), daily_stock=str(d / "stock.csv"),
                       site_mapping=str(d / "site.csv"), product=str(d / "product.csv"),
                       channel="TH", orders_actual=str(d / "orders_actual.tsv"))
    # the duplicated K2 line collapses in the append
    assert load_inputs(spark, paths).orders.count() == 3
    out = run_from_paths(spark, paths, ModelConfig(2026, 2), str(tmp_path / "out"))
    assert os.path.basename(out.root) == "OOS_Opportunity_Lost_TH_2026-02_V5"
    counts = dict(rows(out.round_trip_counts))
    assert counts == {"detail": 4, "unmapped_sites": 1, "summary_total": 3, "summary_site": 2,
                      "summary_sku": 2, "calculation_example": 17, "qa_summary": 20}
    detail = {(r["sku"], r["virtual_site"]): r for r in out.datasets["detail"].collect()}
    # K1 has no name in the product list -> first order name; sold in Feb -> no loss
    assert detail[("K1", "wh-bkk")]["product_name"] == "กระเป๋า"
    assert detail[("K1", "wh-bkk")]["gross_per_unit"] == 1116 / 93
    assert os.path.isdir(out.paths["detail"] + "_csv")
    meta = spark.read.parquet(out.paths["detail"] + "/channel=th/period=2026-02").schema["oos_days_jan"].metadata
    assert "month days" in meta["comment"]


def test_workbook_sheet_tables(spark, tmp_path):
    wb = tmp_path / "wb"
    wb.mkdir()
    write(wb / "WEB-CN.csv", "Sales export March\n"
          "DATE,ORDER NO,SKU,DESCRIPTION,QTY,GROSS,NET,Storage Location\n"
          "01.02.2026,ORDER-1,SKU-1,Bag,2,100,90,WH-BKK\n"
          "15.02.2026,ORDER-2,SKU-2,Watch,4,200,180,WH-BKK-DELIVERY\n")
    sheets = RD.read_workbook_sheets(spark, str(wb), ("WEB-CN",))
    df = sheets["WEB-CN"]
    assert df.columns[:3] == ["DATE", "ORDER NO", "SKU"]
    assert rows(df, "SKU", "QTY") == [("SKU-1", "2"), ("SKU-2", "4")]
    assert RD.missing_sheets(RD.available_sheets(spark, str(wb)), ("WEB-CN", "Cross-Border")) == [
        "Cross-Border"]


def test_snapshot_job(spark, tmp_path):
    wh = spark.createDataFrame(
        [(dt.date(2026, 3, 1), "1110", "L1", "A1", "Bag", 2.0),
         (dt.date(2026, 3, 2), "1112", "L2", "A1", "Bag", 1.0)],
        "posting_date date, site_code string, location string, article_code string, "
        "latest_article_description string, stock_balance double")
    sites = SN.channel_sites_from_lists(spark, {"th": ["1110"], "tht": ["1112"]})
    skus = spark.createDataFrame([("A1",)], "Article_Code string")
    res = run_snapshot_job(spark, wh, sites, skus, dt.date(2026, 3, 1), dt.date(2026, 3, 31),
                           str(tmp_path), csv=True)
    assert "daily_stock - 2026-03-01_to_2026-03-31" in res.rows_path
    assert [r[:6] for r in rows(res.summary)] == [("th", "TH", "", 1, 1, 1), ("tht", "THT", "", 1, 1, 1)]
    assert spark.read.parquet(res.rows_path).filter(F.col("channel") == "th").count() == 1


def test_workbook_site_map_and_month(spark, tmp_path):
    from shelfgap.plans.jobs import read_table, suggest_month_from_path, SITE_MAP_SHEET
    wb = tmp_path / "site_wb"
    wb.mkdir()
    write(wb / f"{SITE_MAP_SHEET}.csv", "Virtual Location,Site,Active\nWH-BKK,1110,X\n")
    assert rows(read_table(spark, str(wb), SITE_MAP_SHEET, "workbook")) == [("WH-BKK", "1110", "X")]
    d = th_files(tmp_path)
    r = suggest_month_from_path(spark, str(d / "stock.csv")).first()
    assert (r["eval_year"], r["eval_month"], r["is_confident"]) == (2026, 2, True)


def test_utf16_export_is_split_and_exact(spark, tmp_path):
    """The splittable reader equals the single-task reader, CRLF and BOM included."""
    lines = ["Purchase Date\tSku\tstock\tQuantity\tGross\tNet\tProduct Name"]
    lines += [f"2026-02-{i % 28 + 1:02d}\tK{i}\tWH-BKK\t{i % 7}\t1,{i % 1000:03d}\t{i % 50}\tกระเป๋า {i}"
              for i in range(30000)]
    path = tmp_path / "big.tsv"
    write(path, "\r\n".join(lines) + "\r\n", encoding="utf-16")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(256 * 1024))
    try:
        split = RD.read_orders_export(spark, str(path))
        one = RD.read_orders_export(spark, str(path), multiline=True)
        assert split.rdd.getNumPartitions() > 1
        assert split.columns == one.columns == lines[0].split("\t")
        assert split.count() == 30000
        assert split.exceptAll(one).count() == 0 and one.exceptAll(split).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_utf16_big_endian_export(spark, tmp_path):
    path = tmp_path / "be.tsv"
    write(path, "﻿Purchase Date\tSku\tstock\n2026-02-01\tK1\tWH-BKK\n", encoding="utf-16-be")
    df = RD.read_orders_export(spark, str(path))
    assert df.columns == ["Purchase Date", "Sku", "stock"]
    assert rows(df) == [("2026-02-01", "K1", "WH-BKK")]


def test_quotes_survive_every_text_format(spark, tmp_path):
    """Doubled quotes and commas inside quoted fields, in and out."""
    write(tmp_path / "p.csv", 'skuNo,productName,status\nK1,"Bag 12"", red",live\nK2,"a,b",hide\n')
    got = rows(RD.read_delimited(spark, str(tmp_path / "p.csv")), "skuNo", "productName", "status")
    assert got == [("K1", 'Bag 12", red', "live"), ("K2", "a,b", "hide")]
    write(tmp_path / "o.tsv", 'Sku\tProduct Name\n1\t"Bag 12"" red"\n', encoding="utf-16")
    assert rows(RD.read_orders_export(spark, str(tmp_path / "o.tsv"))) == [("1", 'Bag 12" red')]
    write(tmp_path / "s.csv", 'Title\nA,B\n"x ""y"", z",1\n')
    assert rows(RD.read_sheet_table(spark, str(tmp_path / "s.csv"))) == [('x "y", z', "1")]
    from shelfgap import sinks
    import pandas as pd
    sinks.export_csv(spark.createDataFrame([('say "hi", you',)], "t string"), str(tmp_path / "out"), "none")
    part = max((p for p in (tmp_path / "out").iterdir() if p.name.startswith("part")), key=lambda p: p.stat().st_size)
    assert pd.read_csv(part)["t"].tolist() == ['say "hi", you']


def test_rerun_replaces_its_partition_and_leaves_others(spark, tmp_path):
    """An empty rerun leaves no earlier rows; a later snapshot run lists only its channels."""
    from shelfgap.plans.loss_job import run_loss_job
    from shelfgap.profiles import get_profile
    d = th_files(tmp_path)
    paths = InputPaths(orders=str(d / "orders.tsv"), daily_stock=str(d / "stock.csv"),
                       site_mapping=str(d / "site.csv"), product=str(d / "product.csv"))
    inputs, out, cfg = load_inputs(spark, paths), str(tmp_path / "out"), ModelConfig(2026, 2)
    first = run_loss_job(spark, inputs, cfg, get_profile("th"), out)
    assert rows(first.datasets["unmapped_sites"]) == [("ZZZZ", 1)]
    inputs.site_map = inputs.site_map.unionByName(spark.createDataFrame(
        [("th", "ZZZZ", "wh-bkk")], "channel string, site_code string, virtual_site string"))
    again = run_loss_job(spark, inputs, cfg, get_profile("th"), out)
    assert rows(again.datasets["unmapped_sites"]) == []
    qa = {r["metric"]: r["value"] for r in again.datasets["qa_summary"].collect()}
    assert qa["unmapped_site_code_count"] == 0
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").upper() == "STATIC"
    wh = spark.createDataFrame([(dt.date(2026, 3, 1), "1110", "L1", "A1", "Bag", 2.0)],
                               "posting_date date, site_code string, location string, article_code string, "
                               "latest_article_description string, stock_balance double")
    skus = spark.createDataFrame([("A1",)], "Article_Code string")
    for channels in ({"th": ["1110"], "tht": ["1110"]}, {"th": ["1110"]}):
        res = run_snapshot_job(spark, wh, SN.channel_sites_from_lists(spark, channels), skus,
                               dt.date(2026, 3, 1), dt.date(2026, 3, 31), str(tmp_path))
    assert {r["channel"] for r in spark.read.parquet(res.rows_path).collect()} == {"th"}


def test_file_uris_and_said_formats(spark, tmp_path):
    """Parquet, workbook and output folders named by file:// paths; nothing is guessed."""
    from pyspark.sql import functions as F2
    d = th_files(tmp_path)
    uri = "file://" + str(tmp_path)
    RD.read_orders_export(spark, str(d / "orders.tsv")).write.parquet(uri + "/orders")
    (tmp_path / "wb").mkdir()
    write(tmp_path / "wb" / "Include.csv", (d / "site.csv").read_text())
    paths = InputPaths(orders=uri + "/orders", daily_stock=f"file://{d}/stock.csv", site_mapping=uri + "/wb",
                       product=f"file://{d}/product.csv", formats={"orders": "parquet", "site_mapping": "workbook"})
    out = run_from_paths(spark, paths, ModelConfig(2026, 2), uri + "/out2", run_log=uri + "/log")
    assert out.datasets["detail"].count() == 4
    assert [r["status"] for r in spark.read.parquet(uri + "/log").collect()] == ["success"]
    import pytest
    bad = InputPaths(**{**paths.__dict__, "daily_stock": uri + "/nothing.csv"})
    with pytest.raises(Exception):
        run_from_paths(spark, bad, ModelConfig(2026, 2), uri + "/out3", run_log=uri + "/log")
    last = spark.read.parquet(uri + "/log").orderBy(F2.desc("logged_at")).first()
    assert (last["ok"], last["status"]) == (False, "failed") and "nothing.csv" in last["error_message"]
    with pytest.raises(ValueError, match="output folder"):
        from shelfgap.plans.loss_job import run_loss_job
        run_loss_job(spark, None, ModelConfig(2026, 2), None, "")


def test_findings_of_paths(spark, tmp_path):
    from shelfgap.plans.jobs import check_paths
    d = th_files(tmp_path)
    (tmp_path / "broken.parquet").write_text("no parquet")
    paths = InputPaths(orders="", daily_stock=str(d / "none.csv"), site_mapping=str(d / "site.csv"),
                       product=str(tmp_path / "broken.parquet"), formats={"product": "parquet", "site_mapping": "docx"})
    got = {(r["dataset"], r["code"]) for r in check_paths(spark, paths).collect()}
    assert got == {("sales", "missing_staged_path"), ("stock", "missing_staged_file"),
                   ("sku_live", "unreadable_file"), ("site_mapping", "unsupported_format")}


def test_first_name_follows_file_order(spark, tmp_path):
    """Rows of a.csv come before those of a larger b.csv, however Spark packs the files."""
    from shelfgap.plans.jobs import read_table, with_file_order
    from shelfgap.sources import loaders as L
    (tmp_path / "many").mkdir()
    write(tmp_path / "many" / "a.csv", "skuNo,productName,status\nK1,zz first,live\n")
    write(tmp_path / "many" / "b.csv", "skuNo,productName,status\n" + "".join(
        f"K{i % 50},aa later {i},live\n" for i in range(5000)))
    got = L.load_product_list(with_file_order(read_table(spark, str(tmp_path / "many"))))
    assert got.filter("sku = 'K1'").first()["product_name"] == "zz first"


def test_channels_of_their_own(spark, tmp_path):
    """Two channels' inputs in one set: each has its own orders and products."""
    from shelfgap.operators import model as M
    from shelfgap.plans.jobs import load_channels, parse_arguments
    d = th_files(tmp_path)
    th = InputPaths(orders=str(d / "orders.tsv"), daily_stock=str(d / "stock.csv"),
                    site_mapping=str(d / "site.csv"), product=str(d / "product.csv"))
    wb = tmp_path / "cn"
    wb.mkdir()
    write(wb / "WEB-CN.csv", "Title\nDATE,ORDER NO,SKU,DESCRIPTION,QTY,GROSS,NET,Storage Location\n"
          "10.10.2025,O1,K1,CN Bag,92,9200,4600,WH-BKK\n")
    for sheet in ("click&collect", "HomeDelivery"):
        write(wb / f"{sheet}.csv", "Title\nSKU CODE,DESCRIPTION,WEB STATUS\nK1,CN Bag,live\n")
    cn = InputPaths(orders=str(wb), daily_stock=str(d / "stock.csv"), site_mapping=str(d / "site.csv"),
                    product=str(wb), channel="cn")
    both = load_channels(spark, [th, cn])
    detail = {(r["channel"], r["sku"], r["virtual_site"]): r
              for r in M.loss_detail(both, ModelConfig(2026, 2)).collect()}
    assert detail["th", "K1", "wh-bkk"]["gross_per_unit"] == 12.0
    assert detail["kingpowercn", "K1", "wh-bkk"]["gross_per_unit"] == 100.0
    assert ("kingpowercn", "K2", "wh-bkk") not in detail and ("th", "K2", "wh-bkk") in detail
    paths, cfg, _ = parse_arguments("--orders o --daily-stock s --site-map m --product p --output x --eval-year 2026 "
                                    "--eval-month 2 --channel KPCN --baseline-months 3".split())
    assert (paths.channel, cfg.recent_start) == ("kingpowercn", dt.date(2025, 11, 1))
