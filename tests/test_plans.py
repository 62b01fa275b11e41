"""Plan hygiene: no query plans a cross / nested-loop join or a Python UDF,
and the month filter reaches the Parquet scan."""

import contextlib
import io

import pytest

from conftest import SF_SMALL
from shelfgap.plans.catalog import QUERIES

FORBIDDEN = ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython",
             "ArrowEvalPython", "PythonUDF")


def plan_text(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_cross_join_or_python(spark, key):
    text = plan_text(QUERIES[key](spark, SF_SMALL))
    assert not [w for w in FORBIDDEN if w in text]


def test_month_filter_pushed_to_scan(spark):
    text = plan_text(QUERIES["day_balance"](spark, SF_SMALL))
    assert "GreaterThanOrEqual(l_shipdate,1998-06-01" in text
    assert "LessThan(l_shipdate,1998-07-01" in text


def test_month_partitioned_stock_is_pruned(spark, tmp_path):
    from pyspark.sql import functions as F
    from shelfgap.operators import stock as K
    from shelfgap.plans import catalog as CAT
    from shelfgap.sources import adapter as A
    from shelfgap.sources import loaders as L
    from shelfgap.sources import readers as RD
    cfg = A.test_config()
    tt = A.open_tables(spark, SF_SMALL)
    path = RD.land_stock_by_month(A.stock_raw(tt), str(tmp_path / "stock"))
    landed = L.load_daily_stock(spark.read.parquet(path))
    i = CAT.inputs(spark, SF_SMALL)
    got = K.day_balance(landed, i.site_map, cfg)
    text = plan_text(got)
    assert "PartitionFilters" in text and "posting_month" in text
    want = K.day_balance(i.stock, i.site_map, cfg)
    cols = ["channel", "posting_date", "sku", "virtual_site", "stock_balance"]
    as_rows = lambda df: sorted(tuple(r) for r in df.select(*cols).collect())
    assert as_rows(got) == as_rows(want)


def test_month_partitioned_orders_are_pruned(spark, tmp_path):
    from shelfgap.operators import sales as S
    from shelfgap.plans import catalog as CAT
    from shelfgap.sources import adapter as A
    from shelfgap.sources import loaders as L
    from shelfgap.sources import readers as RD
    cfg = A.test_config()
    tt = A.open_tables(spark, SF_SMALL)
    path = RD.land_orders_by_month(A.sales_raw(tt), str(tmp_path / "orders"))
    landed = L.load_orders(spark.read.parquet(path), "th")
    got = S.window_sales(landed, cfg)
    text = plan_text(got)
    assert "PartitionFilters" in text and "purchase_month" in text
    want = S.window_sales(CAT.inputs(spark, SF_SMALL).orders, cfg)
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in want.collect())


def test_reports_evaluate_the_model_once(spark):
    """The worked example reads no table more often than the detail itself; what the overview and
    the run record count comes from written tables, so their plans hold no model."""
    scans = lambda key: plan_text(QUERIES[key](spark, SF_SMALL)).count("Scan parquet")
    model = scans("loss_detail")
    assert scans("calc_example") <= model
    assert "lineitem.parquet" not in plan_text(QUERIES["run_record"](spark, SF_SMALL))
    text = plan_text(QUERIES["overview_trust"](spark, SF_SMALL))
    assert "/detail/channel=" in text and "SortMergeJoin LeftOuter" not in text


def test_staleness_reads_landed_inputs(spark):
    assert "lineitem.parquet" not in plan_text(QUERIES["input_staleness"](spark, SF_SMALL))


def test_line_items_are_not_moved_for_suppliers(spark, monkeypatch):
    from shelfgap.sources import adapter as A
    tt = A.open_tables(spark, SF_SMALL)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = A.sales_raw(tt)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") == 1 and "l_suppkey" in plan
        assert "hashpartitioning(l_suppkey" not in plan
        monkeypatch.setattr(A, "BROADCAST_SUPPLIERS", 0)
        plain = A.sales_raw(tt)
        assert "BroadcastHashJoin" not in plain._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, joined.collect())) == sorted(map(str, plain.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_snapshot_rows_are_ordered_in_their_files(spark, tmp_path):
    """H7: date, location, article inside each file, and over the whole CSV export."""
    import glob

    import pyarrow.parquet as pq
    from shelfgap.plans.snapshot_job import run_snapshot_job
    from shelfgap.sources import adapter as A
    tt = A.open_tables(spark, SF_SMALL)
    res = run_snapshot_job(spark, A.warehouse_stock(tt), A.snapshot_channel_sites(tt), A.snapshot_sku_filter(tt),
                           A.SNAPSHOT_START, A.SNAPSHOT_END, str(tmp_path))
    files = glob.glob(res.rows_path + "/channel=*/*.parquet")
    assert files
    for f in files:
        t = pq.ParquetFile(f).read(columns=["posting_date", "location", "article_code"]).to_pylist()
        keys = [tuple(r.values()) for r in t]
        assert keys == sorted(keys)
