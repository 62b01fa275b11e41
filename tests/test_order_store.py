"""The order store (F5 by month, E4-E8 from monthly sums), published versions, places and file order."""

import datetime as dt
import glob
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from test_plans import plan_text

from shelfgap import sinks
from shelfgap.operators import model as M
from shelfgap.operators import reports as R
from shelfgap.operators import sales as S
from shelfgap.plans import catalog as CAT
from shelfgap.plans.loss_job import load_results, run_loss_job
from shelfgap.publishing import publish, published
from shelfgap.sources import adapter as A
from shelfgap.sources import loaders as L
from shelfgap.sources import order_store as OS

LINE = ("purchase_date date, sku string, stock_code string, quantity decimal(18,2), gross decimal(18,2), "
        "net decimal(18,4), product_name string, excluded_prefix_p boolean")


def line(day, sku, qty, name="n", site="s"):
    return (dt.date.fromisoformat(day), sku, site, Decimal(qty), Decimal(10 * qty), Decimal(9 * qty), name, sku.startswith("P"))


def frame(spark, *lines):
    return spark.createDataFrame(list(lines), LINE)


def known(spark, root):
    return sorted((r["purchase_date"].isoformat(), r["sku"], int(r["quantity"]), r["purchase_month"])
                  for r in OS.lines(spark, root).collect())


def test_append_is_union_distinct_by_month(spark, tmp_path):
    root = str(tmp_path / "store")
    history = frame(spark, line("2026-01-05", "K1", 1), line("2026-01-05", "K1", 1), line("2026-02-01", "K2", 2))
    current = frame(spark, line("2026-02-01", "K2", 2), line("2026-02-09", "K3", 3), line("2026-03-01", "K4", 4))
    assert OS.append(spark, root, history) == 1
    assert OS.append(spark, root, current) == 2
    assert known(spark, root) == [("2026-01-05", "K1", 1, "2026-01"), ("2026-02-01", "K2", 2, "2026-02"),
                                  ("2026-02-09", "K3", 3, "2026-02"), ("2026-03-01", "K4", 4, "2026-03")]
    # again the same: nothing changes
    OS.append(spark, root, current)
    assert len(known(spark, root)) == 4
    assert rows(OS.sums(spark, root).where("sku = 'K2'"), "purchase_month", "month_rows") == [("2026-02", 1)]


def test_only_shared_months_are_read_and_written_again(spark, tmp_path):
    root = str(tmp_path / "store")
    OS.append(spark, root, frame(spark, *[line(f"2026-{m:02d}-03", f"K{m}", m) for m in range(1, 7)]))
    OS.append(spark, root, frame(spark, line("2026-06-03", "K6", 6), line("2026-07-01", "K7", 7)))
    places = published(spark, root)[1]["lines"]
    assert {m: places[m] for m in places} == {**{f"2026-{m:02d}": 2 for m in range(1, 6)}, "2026-06": 5, "2026-07": 4}
    written = {re.search(r"written=(\d)/purchase_month=(\S+)/", f + "/").groups()
               for f in glob.glob(f"{root}/lines/written=*/purchase_month=*")}
    assert {m for w, m in written if w == "5"} == {"2026-06"} and {m for w, m in written if w == "4"} == {"2026-06", "2026-07"}


def test_the_shuffle_of_an_append_holds_shared_months_alone(spark, tmp_path):
    """The merge reads the folders of months in both files, and no other."""
    root = str(tmp_path / "store")
    orders = L.load_orders(A.sales_raw(A.open_tables(spark, SF_SMALL)), "th")
    OS.append(spark, root, orders.where(F.col("purchase_date") < F.lit(A.APPEND_HISTORY_END)))
    seen = []
    original = OS._read

    def spy(spark, root, kind, schema, places):
        seen.append((kind, set(places)))
        return original(spark, root, kind, schema, places)

    OS._read = spy
    try:
        OS.append(spark, root, orders.where(F.col("purchase_date") >= F.lit(A.APPEND_CURRENT_START)))
    finally:
        OS._read = original
    assert [m for k, m in seen[:2] if k == "lines"] == [{"1998-05", "1998-06"}] * 2
    # the sums are made of the current file's months alone
    assert min(seen[2][1]) == "1998-05"


def test_a_second_month_reads_one_month_of_lines(spark, tmp_path):
    root = str(tmp_path / "store")
    OS.append(spark, root, frame(spark, line("2026-01-05", "K1", 1), line("2026-02-05", "K1", 2)))
    OS.append(spark, root, frame(spark, line("2026-03-05", "K1", 4)))
    text = plan_text(S.sales_lines(OS.sums(spark, root), M.ModelConfig(2026, 3)))
    assert f"{root}/lines" not in text and "month_qty" in text
    got = S.window_sales(OS.sums(spark, root), M.ModelConfig(2026, 3)).first()
    assert (got["recent_qty"], got["actual_qty_jan"]) == (3.0, 4.0)


def test_sums_by_month_give_the_same_lines(spark, tmp_path):
    root = str(tmp_path / "store")
    orders = L.load_orders(A.sales_raw(A.open_tables(spark, SF_SMALL)), "th").distinct()
    OS.append(spark, root, orders)
    cfg = A.test_config()

    def plain(df):
        return sorted(tuple(None if x is None else str(x) if isinstance(x, str) else float(x) for x in
                            (*r[:3], *r["m"])) for r in df.collect())
    assert plain(S.sales_lines(OS.sums(spark, root), cfg)) == plain(S.sales_lines(orders, cfg))


def test_first_places_are_kept_over_appends(spark, tmp_path):
    root = str(tmp_path / "store")
    place = F.struct(F.lit("f").alias("file"), F.monotonically_increasing_id().alias("line"))
    one = frame(spark, line("2026-01-05", "K1", 1, "zebra"), line("2026-01-06", "K1", 1, "ant")).coalesce(1)
    two = frame(spark, line("2026-01-04", "K1", 1, "aardvark")).coalesce(1)
    OS.append(spark, root, one.withColumn("row_ord", place))
    OS.append(spark, root, two.withColumn("row_ord", place))
    price = S.unit_price(OS.lines(spark, root), M.ModelConfig(2026, 3)).first()
    assert price["product_name"] == "zebra"
    assert S.unit_price(OS.sums(spark, root), M.ModelConfig(2026, 3)).first()["product_name"] == "zebra"


def test_a_failed_append_changes_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    OS.append(spark, root, frame(spark, line("2026-01-05", "K1", 1)))
    monkeypatch.setattr(OS, "month_sums", lambda lines: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        OS.append(spark, root, frame(spark, line("2026-01-05", "K9", 9)))
    assert known(spark, root) == [("2026-01-05", "K1", 1, "2026-01")]


def test_odd_appends(spark, tmp_path):
    root = str(tmp_path / "store")
    with pytest.raises(ValueError, match="no order store"):
        OS.lines(spark, root)
    assert OS.append(spark, root, frame(spark)) == 1
    assert known(spark, root) == [] and OS.sums(spark, root).count() == 0
    assert OS.append(spark, root, frame(spark, line("2026-01-05", "K1", 1))) == 2
    assert OS.append(spark, root, frame(spark)) == 2
    with pytest.raises(ValueError, match="other columns"):
        OS.append(spark, root, frame(spark).drop("net"))


def test_a_version_is_published_once(spark, tmp_path):
    root = str(tmp_path / "p")
    assert published(spark, root) is None
    publish(spark, root, 1, {"a": "ä\n"})
    with pytest.raises(Exception):
        publish(spark, root, 1, {"a": 2})
    publish(spark, root, 2, {"a": 3})
    (tmp_path / "p" / "versions" / "v000000003").mkdir()      # begun, never finished
    assert published(spark, root) == (2, {"a": 3})


def test_append_queries_plan_no_lines_for_the_sums(spark):
    text = plan_text(CAT.QUERIES["append_then_model_by_month"](spark, SF_SMALL))
    assert "month_qty" in text and "/lines" not in text


def test_an_append_deals_out_its_lines_once(spark):
    """The grouping and the folders by month share one exchange."""
    new = frame(spark, line("2026-01-05", "K1", 1), line("2026-01-05", "K1", 1)).withColumn("purchase_month", F.date_format("purchase_date", "yyyy-MM"))
    for df in (OS.distinct_lines(new), OS.month_sums(new)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning(") == 1 and "hashpartitioning(purchase_month" in plan and "_slice" in plan
        assert "_slice" not in df.columns and df.count() == 1


def test_appends_read_landed_lines(spark, monkeypatch):
    seen, original = [], OS.append
    monkeypatch.setattr(OS, "append", lambda spark, root, orders: seen.append(plan_text(orders)) or original(spark, root, orders))
    CAT._appended_store(spark, SF_SMALL)
    assert len(seen) == 2 and not [text for text in seen if "lineitem.parquet" in text]


# ---- published runs ----------------------------------------------------------
def test_a_run_that_fails_leaves_the_earlier_one(spark, tmp_path, monkeypatch):
    i, cfg = CAT.inputs(spark, SF_SMALL), A.test_config()
    root = run_loss_job(spark, i, cfg, A.TEST_CHANNEL, str(tmp_path)).root
    before = rows(load_results(spark, root)["summary_total"])
    monkeypatch.setattr(R, "summary_site", lambda d: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        run_loss_job(spark, i, cfg, A.TEST_CHANNEL, str(tmp_path))
    got = load_results(spark, root)
    assert rows(got["summary_total"]) == before and got["detail"].count() > 0
    monkeypatch.undo()
    run_loss_job(spark, i, cfg, A.TEST_CHANNEL, str(tmp_path))
    assert published(spark, root)[0] == 2


def test_results_that_are_not_there_fail(spark, tmp_path):
    import shutil
    with pytest.raises(ValueError, match="has succeeded"):
        load_results(spark, str(tmp_path / "none"))
    i = CAT.inputs(spark, SF_SMALL)
    out = run_loss_job(spark, i, A.test_config(), A.TEST_CHANNEL, str(tmp_path))
    shutil.rmtree(out.paths["qa_summary"])
    with pytest.raises(ValueError, match="qa_summary"):
        load_results(spark, out.root)


def test_qa_counts_are_taken_in_passing(spark, tmp_path, monkeypatch):
    """In a run neither orders nor stock are read for the QA metrics."""
    from shelfgap.operators import quality as Q
    plans = []
    original = Q.qa_summary

    def spy(*args, **kwargs):
        df = original(*args, **kwargs)
        plans.append(plan_text(df))
        return df

    monkeypatch.setattr(Q, "qa_summary", spy)
    i = CAT.inputs(spark, SF_SMALL)
    out = run_loss_job(spark, i, A.test_config(), A.TEST_CHANNEL, str(tmp_path))
    assert "lineitem.parquet" not in plans[0] and "orders.parquet" not in plans[0]
    want = rows(original(i, A.test_config()))
    assert rows(out.datasets["qa_summary"].select("seq", "metric", "value")) == want


# ---- places -------------------------------------------------------------------
def test_places_without_a_single_partition(spark):
    pairs = [(f"s{i:04d}", float((i * 7919) % 97)) for i in range(500)] + [("x", None)]
    df = spark.createDataFrame(pairs, "virtual_site string, lost_value_net_raw double").repartition(7)
    got = sinks.with_place(df, "summary_site")
    assert "SinglePartition" not in plan_text(got)
    order = sorted(pairs, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert rows(got, "place", "virtual_site") == [(i, name) for i, (name, _) in enumerate(order, 1)]
    assert sinks.with_place(df.limit(0), "summary_site").count() == 0


def test_report_order_has_no_single_partition_exchange(spark):
    assert "SinglePartition" not in plan_text(CAT.QUERIES["report_order"](spark, SF_SMALL))
