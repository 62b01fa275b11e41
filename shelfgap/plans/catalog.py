"""Query catalogue: one ``(spark, sf_dir) -> DataFrame`` per SURVEY §7.3 key.

Every query reads the whole test tables through the adapter and runs the
library operators on them; nothing here is sampled or capped (the only
limits are the top-k / top-1 reports, where the limit is the feature).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions.dates import with_best_timestamp
from ..operators import model as M
from ..operators import quality as Q
from ..operators import reports as R
from ..operators import sales as S
from ..operators import sitemap as SM
from ..operators import snapshot as SN
from ..operators import stock as K
from .. import sinks
from ..profiles import CHANNEL_CN, CHANNEL_TH, split_by_channel
from ..session import scratch_path
from ..sources import adapter as A
from ..sources import loaders as L
from ..sources import order_store as OS
from ..sources import readers as RD
from ..sources.contracts import SLOTS
from . import jobs as J
from . import snapshot_job as SJ
from .loss_job import run_loss_job

# spellings of channel names for the channel_keys query; the last three are no channel's
CHANNEL_SPELLINGS = ("TH", " king-power CN", "King_Power_CN", "t/h t", "KPCN", "cn", "", "lotus", "th2")

EXPORT_PART_LINES = 500_000     # order lines in a part of the written export, about 100 MB as plain text

QueryFn = Callable[[SparkSession, str], DataFrame]


def _tt(spark: SparkSession, sf_dir: str) -> A.TestTables:
    return A.open_tables(spark, sf_dir)


def inputs(spark: SparkSession, sf_dir: str, channels=(A.TEST_CHANNEL,)) -> M.ModelInputs:
    tt = _tt(spark, sf_dir)
    return M.ModelInputs(
        product=L.load_products(A.product_raw(tt), CHANNEL_TH),
        orders=L.load_orders(A.sales_raw(tt), CHANNEL_TH),
        stock=L.load_daily_stock(A.stock_raw(tt)),
        site_map=L.load_site_map(A.site_map_raw(tt), list(channels)),
    )


def _detail(spark, sf_dir, channels=(A.TEST_CHANNEL,)) -> DataFrame:
    return M.loss_detail(inputs(spark, sf_dir, channels), A.test_config())


def _one_channel_detail(spark, sf_dir) -> DataFrame:
    return _detail(spark, sf_dir).drop("channel")


# ------------------------------------------------------------- cleaning --
def q_clean_ids(spark, sf_dir):
    """B1 + B3 on export-style dirty ids ('="K12.0" ')."""
    p = _tt(spark, sf_dir).t("part")
    dirty = F.concat(F.lit('="'), A.sku_of(F.col("p_type"), F.col("p_partkey")), F.lit('.0" '))
    return p.select(F.col("p_partkey").alias("part_key"), dirty.alias("raw_id")).select(
        "part_key", "raw_id", C.clean_id("raw_id").alias("sku"),
        C.is_excluded_sku(C.clean_id("raw_id")).alias("excluded_prefix_p"))


def q_parse_numbers(spark, sf_dir):
    """B6 (commas removed) vs B7 (no comma removal) on '1,0NN' texts and 'nan'."""
    li = _tt(spark, sf_dir).t("lineitem")
    text = F.when(F.col("l_returnflag") == "R", F.lit("nan")).otherwise(
        F.concat(F.lit("1,"), F.lpad(F.col("l_quantity").cast("int").cast("string"), 3, "0")))
    raw = li.select("l_orderkey", "l_linenumber", text.alias("raw_text"))
    return raw.select("l_orderkey", "l_linenumber", "raw_text",
                      C.parse_number("raw_text", raw.schema["raw_text"].dataType)
                      .cast("double").alias("value_commas_removed"),
                      C.parse_number("raw_text", raw.schema["raw_text"].dataType,
                                     strip_commas=False).cast("double").alias("value_plain"))


def q_parse_dates_best(spark, sf_dir):
    """B8 + B9: a day-first column and a month-first column, each read by best coverage."""
    o = _tt(spark, sf_dir).t("orders")
    raw = o.select("o_orderkey",
                   F.date_format("o_orderdate", "dd.MM.yyyy").alias("day_first_text"),
                   F.date_format("o_orderdate", "MM/dd/yyyy").alias("month_first_text"))
    read = with_best_timestamp(with_best_timestamp(raw, "day_first_text", "day_first"), "month_first_text", "month_first")
    return read.select("o_orderkey", "day_first_text", "month_first_text",
                       F.to_date("day_first").alias("day_first_date"), F.to_date("month_first").alias("month_first_date"))


# ------------------------------------------------------------- site map --
def q_site_map(spark, sf_dir):
    tt = _tt(spark, sf_dir)
    return L.load_site_map(A.site_map_raw(tt), [A.TEST_CHANNEL]).drop("channel")


def q_site_map_expanded(spark, sf_dir):
    tt = _tt(spark, sf_dir)
    return L.load_site_map(A.site_map_raw(tt), [A.TEST_CHANNEL_2]).drop("channel")


def q_site_map_status(spark, sf_dir):
    tt = _tt(spark, sf_dir)
    return SM.site_map_status(L.load_site_map(A.site_map_raw(tt), [A.TEST_CHANNEL]))


# -------------------------------------------------------------- product --
def q_product_first(spark, sf_dir):
    """the product list repeated later in the file with other names/status."""
    raw = A.product_raw(_tt(spark, sf_dir))
    later = raw.select("skuNo", F.upper("productName").alias("productName"),
                       F.lit("hide").alias("status"),
                       (F.col("row_ord") + F.lit(10**12)).alias("row_ord"))
    return L.load_product_list(raw.unionByName(later))


def q_product_ranked_merge(spark, sf_dir):
    return L.load_products(A.product_sheets_raw(_tt(spark, sf_dir)), CHANNEL_CN)


def q_product_name_column(spark, sf_dir):
    """The name column is chosen per sheet (first candidate with any value)."""
    p = _tt(spark, sf_dir).t("part")
    sku = A.sku_of(F.col("p_type"), F.col("p_partkey"))
    x = p.select(sku.alias("SKU CODE"), F.lit("").alias("商品名称"),
                 F.col("p_name").alias("DESCRIPTION"), F.upper("p_name").alias("英文名"),
                 F.lit("live").alias("WEB STATUS"))
    y = p.select(sku.alias("SKU CODE"), F.col("p_brand").alias("中文名"),
                 F.col("p_name").alias("DESCRIPTION"), F.lit("hide").alias("WEB STATUS"))
    return (L.product_sheet_rows(x, "sheet_x").unionByName(L.product_sheet_rows(y, "sheet_y"))
            .select("sheet_name", "sku", "product_name"))


# --------------------------------------------------------------- orders --
def cn_sheet_orders(spark, sf_dir) -> DataFrame:
    """Order lines in the sheet layout of the other channels: text dates (day
    first), text numbers with thousands separators, upper-case locations."""
    s = A.sales_raw(_tt(spark, sf_dir))
    return s.select(
        F.date_format("Purchase Date", "dd.MM.yyyy").alias("DATE"),
        F.lit("").alias("ORDER NO"),
        F.concat(F.lit(" "), F.col("Sku"), F.lit(".0")).alias("SKU"),
        F.col("Product Name").alias("DESCRIPTION"),
        F.format_number(F.col("Quantity"), 2).alias("QTY"),
        F.format_number(F.col("Gross"), 2).alias("GROSS"),
        F.format_number(F.col("Net"), 4).alias("NET"),
        F.upper(F.col("stock")).alias("Storage Location"))


def _plain_orders(o: DataFrame) -> DataFrame:
    return o.select(F.to_date("purchase_date").alias("purchase_date"), "sku", "stock_code",
                    F.col("quantity").cast("double").alias("quantity"),
                    F.col("gross").cast("double").alias("gross"),
                    F.col("net").cast("double").alias("net"), "product_name",
                    "excluded_prefix_p")


def q_orders_norm(spark, sf_dir):
    return _plain_orders(L.load_orders(cn_sheet_orders(spark, sf_dir), CHANNEL_CN))


def q_orders_append_distinct(spark, sf_dir):
    orders = L.load_orders(A.sales_raw(_tt(spark, sf_dir)), CHANNEL_TH)
    hist = orders.filter(F.col("purchase_date") < F.lit(A.APPEND_HISTORY_END))
    cur = orders.filter(F.col("purchase_date") >= F.lit(A.APPEND_CURRENT_START))
    out = L.append_orders(hist, cur)
    return out.select("purchase_date", "sku", "stock_code",
                      F.col("quantity").cast("double").alias("quantity"),
                      F.col("gross").cast("double").alias("gross"),
                      F.col("net").cast("double").alias("net"), "product_name",
                      "excluded_prefix_p")


# ---------------------------------------------------------------- model --
def q_universe(spark, sf_dir):
    return M.universe(inputs(spark, sf_dir).product, A.test_config())


def q_universe_no_live(spark, sf_dir):
    prod = inputs(spark, sf_dir).product.withColumn("status", F.lit("hide"))
    return M.universe(prod, A.test_config())


def q_day_balance(spark, sf_dir):
    i = inputs(spark, sf_dir)
    return (K.day_balance(i.stock, i.site_map, A.test_config())
            .select("posting_date", "sku", "virtual_site",
                    F.col("stock_balance").cast("double").alias("stock_balance")))


def q_oos_days(spark, sf_dir):
    return M.oos_days(inputs(spark, sf_dir), A.test_config()).drop("channel")


def q_window_sales(spark, sf_dir):
    return S.window_sales(inputs(spark, sf_dir).orders, A.test_config())


def q_baseline(spark, sf_dir):
    return S.baseline(inputs(spark, sf_dir).orders, A.test_config())


def q_unit_price(spark, sf_dir):
    return S.unit_price(inputs(spark, sf_dir).orders, A.test_config())


def q_loss_detail(spark, sf_dir):
    return _one_channel_detail(spark, sf_dir)


def q_loss_detail_two_channels(spark, sf_dir):
    return _detail(spark, sf_dir, (A.TEST_CHANNEL, A.TEST_CHANNEL_2))


def q_loss_detail_toggles_off(spark, sf_dir):
    """I3 with both model toggles off: every non-P SKU, loss kept even when sold."""
    cfg = A.test_config(use_live_skus_only=False, loss_only_when_actual_zero=False)
    return M.loss_detail(inputs(spark, sf_dir), cfg).drop("channel")


def q_loss_detail_feb(spark, sf_dir):
    """I3 for a 28-day month (1998-02): windows 184 / 181 days."""
    cfg = M.ModelConfig(eval_year=1998, eval_month=2)
    return M.loss_detail(inputs(spark, sf_dir), cfg).drop("channel")


def q_unmapped_sites(spark, sf_dir):
    i = inputs(spark, sf_dir)
    return K.unmapped_sites(i.stock, i.site_map, A.test_config())


# -------------------------------------------------------------- reports --
def q_summary_total(spark, sf_dir):
    return R.summary_total(_one_channel_detail(spark, sf_dir))


def q_summary_site(spark, sf_dir):
    return R.summary_site(_one_channel_detail(spark, sf_dir))


def q_summary_sku_pivot(spark, sf_dir):
    i = inputs(spark, sf_dir)
    detail = M.loss_detail(i, A.test_config()).drop("channel")
    return R.summary_sku(detail, M.site_names(i.site_map))


def q_top_sites(spark, sf_dir):
    return R.top_sites(R.summary_site(_one_channel_detail(spark, sf_dir)), 5)


def q_top_skus(spark, sf_dir):
    i = inputs(spark, sf_dir)
    detail = M.loss_detail(i, A.test_config()).drop("channel")
    return R.top_skus(R.summary_sku(detail, M.site_names(i.site_map)), 5)


def q_calc_example(spark, sf_dir):
    return R.calculation_example(_one_channel_detail(spark, sf_dir))


# -------------------------------------------------------------- quality --
def q_qa_summary(spark, sf_dir):
    i = inputs(spark, sf_dir)
    return Q.qa_summary(i, A.test_config())


def _raw_inputs(spark, sf_dir) -> dict[str, DataFrame]:
    tt = _tt(spark, sf_dir)
    return {"sales": A.sales_raw(tt), "stock": A.stock_raw(tt),
            "sku_live": A.product_raw(tt), "site_mapping": A.site_map_raw(tt)}


def q_input_profile(spark, sf_dir):
    raw = _raw_inputs(spark, sf_dir)
    return Q.input_profiles({"sales": raw["sales"], "stock": raw["stock"]}, CHANNEL_TH)


def q_input_findings(spark, sf_dir):
    raw = _raw_inputs(spark, sf_dir)
    # the same tables checked against the TH contract and the TPCH sites
    return Q.input_findings(raw, CHANNEL_TH, site_profile=A.TEST_CHANNEL)


def q_quality_gate(spark, sf_dir):
    raw = _raw_inputs(spark, sf_dir)
    return Q.quality_gate(Q.input_findings(raw, CHANNEL_TH, site_profile=A.TEST_CHANNEL),
                          list(raw) + [f"site_mapping_{CHANNEL_TH}"], SLOTS)


def _broken_inputs(spark, sf_dir) -> dict[str, DataFrame]:
    """Stock without its article codes, orders whose shipped dates are text that is no date,
    no product list at all, and a table for which there is no slot."""
    tt = _tt(spark, sf_dir)
    sales = A.sales_raw(tt)
    text = F.when(F.col("Quantity") < 0, F.lit("returned")).otherwise(F.col("Purchase Date").cast("string"))
    return {"sales": sales.withColumn("Purchase Date", text), "stock": A.stock_raw(tt).drop("article_code"),
            "site_mapping": A.site_map_raw(tt), "suppliers": tt.t("supplier")}


def q_input_findings_broken(spark, sf_dir):
    """I4 on broken inputs: unknown_slot, missing_required_columns, unparsed_dates."""
    return Q.input_findings(_broken_inputs(spark, sf_dir), CHANNEL_TH, site_profile=A.TEST_CHANNEL)


def q_quality_gate_broken(spark, sf_dir):
    """E22 on the same: the absent product list blocks the run too."""
    raw = _broken_inputs(spark, sf_dir)
    return Q.quality_gate(Q.input_findings(raw, CHANNEL_TH, site_profile=A.TEST_CHANNEL), list(raw), SLOTS)


def q_month_suggestion(spark, sf_dir):
    return Q.month_suggestion(inputs(spark, sf_dir).stock)


def q_overview_totals(spark, sf_dir):
    return Q.overview_totals(R.summary_total(_one_channel_detail(spark, sf_dir)))


def _run(spark, sf_dir):
    """One loss run into the shared folder; the model is evaluated by its writes alone."""
    return run_loss_job(spark, inputs(spark, sf_dir), A.test_config(), A.TEST_CHANNEL,
                        scratch_path(spark, "loss-run"))


def q_overview_trust(spark, sf_dir):
    out = _run(spark, sf_dir).datasets
    findings = Q.input_findings(_raw_inputs(spark, sf_dir), CHANNEL_TH, site_profile=A.TEST_CHANNEL)
    return Q.overview(out["detail"], out["qa_summary"], out["unmapped_sites"], findings,
                      period=A.test_config().period)


def q_input_fingerprint(spark, sf_dir):
    return Q.fingerprints(_raw_inputs(spark, sf_dir))


def q_input_staleness(spark, sf_dir):
    """Inputs against stored fingerprints of a product list in other spelling, without the site map."""
    raw = _raw_inputs(spark, sf_dir)
    for name in ("sales", "stock"):     # landed once: they are read for the stored fingerprints and for the current ones
        raw[name] = spark.read.parquet(RD.land_as_parquet(raw[name], scratch_path(spark, f"{name}-input")))
    before = dict(raw, sku_live=raw["sku_live"].withColumn("status", F.upper("status")))
    del before["site_mapping"]
    stored = scratch_path(spark, "fingerprints")
    Q.fingerprints(before).write.parquet(stored)
    return Q.changed_inputs(Q.fingerprints(raw), spark.read.parquet(stored))


def q_run_record(spark, sf_dir):
    return _run(spark, sf_dir).record


# ------------------------------------------------------------- snapshot --
def _snapshot(spark, sf_dir):
    tt = _tt(spark, sf_dir)
    return SN.stock_snapshot(A.warehouse_stock(tt), A.snapshot_channel_sites(tt),
                             A.snapshot_sku_filter(tt), A.SNAPSHOT_START, A.SNAPSHOT_END)


def q_stock_snapshot(spark, sf_dir):
    return _snapshot(spark, sf_dir)


def q_snapshot_summary(spark, sf_dir):
    tt = _tt(spark, sf_dir)
    snap = _snapshot(spark, sf_dir)
    return SN.snapshot_summary(snap, A.snapshot_channel_sites(tt), A.snapshot_sku_filter(tt),
                               "Live SKUs", "part", "snapshot/rows")


# ---------------------------------------------------------------- sinks --
def q_results_round_trip(spark, sf_dir):
    """K1 + A14: row counts and the contents' sums of all datasets, from the written files."""
    out = _run(spark, sf_dir).datasets
    sums = {"detail": "lost_value_net_raw", "unmapped_sites": "rows", "summary_total": "value",
            "summary_site": "lost_value_net_raw", "summary_sku": "loss_net", "qa_summary": "value",
            "calculation_example": "seq"}
    return reduce(DataFrame.unionByName, [
        df.agg(F.count(F.lit(1)).alias("rows"), R.exact_sum(F.round(F.col(sums[name]), 6)).alias("total"))
        .select(F.lit(name).alias("dataset"), "rows", "total") for name, df in out.items()])


def two_channels(spark, sf_dir) -> M.ModelInputs:
    """Channels with their own orders, prices, products and names over one stock table."""
    i = inputs(spark, sf_dir, (A.TEST_CHANNEL, A.TEST_CHANNEL_2))
    one, two = A.TEST_CHANNEL.key, A.TEST_CHANNEL_2.key
    other = i.orders.filter("stock_code <> 'europe'").withColumns(
        {"gross": F.col("gross") + F.col("gross"), "net": F.col("net") + F.col("gross")})
    hidden = i.product.filter("sku not like '%7'").withColumns(
        {"product_name": F.when(~F.col("sku").endswith("3"), F.upper("product_name")),  # B25: else the orders' name
         "status": F.lit("hide")})

    def keyed(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.withColumn("channel", F.lit(one)).unionByName(b.withColumn("channel", F.lit(two)))

    return M.ModelInputs(keyed(i.product, hidden), keyed(i.orders, other), i.stock, i.site_map)


def q_loss_detail_own_inputs(spark, sf_dir):
    """I3 for two channels in one plan, each with its own orders, prices and products."""
    return M.loss_detail(two_channels(spark, sf_dir), A.test_config())


def q_unmapped_sites_two_channels(spark, sf_dir):
    """E9 per channel: a code mapped in the first channel may be unmapped in the second."""
    i = inputs(spark, sf_dir, (A.TEST_CHANNEL, A.TEST_CHANNEL_2))
    return K.unmapped_sites(i.stock, i.site_map, A.test_config(), per_channel=True)


def q_channel_keys(spark, sf_dir):
    """B12 as a column: spellings of channel names; names that no channel goes by have no key."""
    p = _tt(spark, sf_dir).t("part")
    names = F.array(*[F.lit(x) for x in CHANNEL_SPELLINGS])
    raw = p.select("p_partkey", F.get(names, (F.col("p_partkey") % len(CHANNEL_SPELLINGS)).cast("int")).alias("name"))
    known, rejected = split_by_channel(raw, "name")
    return known.unionByName(rejected.withColumn("channel", F.lit(None).cast("string")))


def q_text_round_trip(spark, sf_dir):
    """A6 + A7 + K2 through text files: products whose names hold quotes and commas, and stock
    dates in six layouts, are written as CSV, read back and normalized."""
    tt = _tt(spark, sf_dir)
    p = A.product_raw(tt)
    quoted = p.withColumn("productName", F.concat(F.lit('12", "'), F.col("productName"), F.lit('", big')))
    path = scratch_path(spark, "products")
    quoted.write.option("header", True).options(**RD.QUOTING).csv(path)
    products = L.load_product_list(RD.read_delimited(spark, path))
    d = F.col("posting_date")
    layouts = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss'Z'", "d-MMM-yyyy", "yyyyMMdd",
               "M/d/yy", "MM/dd/yyyy hh:mm a"]
    which = F.pmod(F.crc32(F.concat("site_code", "article_code").cast("binary")), F.lit(len(layouts)))
    text = F.coalesce(*[F.when(which == k, F.date_format(d, layout)) for k, layout in enumerate(layouts)])
    path = scratch_path(spark, "stock")
    A.stock_raw(tt).withColumn("posting_date", text).write.option("header", True).options(**RD.QUOTING).csv(path)
    stock = L.load_daily_stock(RD.read_delimited(spark, path))
    days = stock.groupBy("sku", "posting_date").agg(F.sum("stock_balance").cast("double").alias("balance"))
    return days.join(products, "sku").select("sku", "product_name", "status", "posting_date", "balance")


def q_report_order(spark, sf_dir):
    """H1-H4: the place of each row of the detail, both summaries and the unmapped codes in the
    order in which people see them."""
    i = inputs(spark, sf_dir)
    path = scratch_path(spark, "detail")
    M.loss_detail(i, A.test_config()).drop("channel").write.parquet(path)
    detail = spark.read.parquet(path)
    frames = {"detail": (detail, F.concat_ws(" | ", "sku", "virtual_site")),
              "summary_site": (R.summary_site(detail), F.col("virtual_site")),
              "summary_sku": (R.summary_sku(detail, []), F.col("sku")),
              "unmapped_sites": (K.unmapped_sites(i.stock, i.site_map, A.test_config()), F.col("site_code"))}
    return reduce(DataFrame.unionByName, [
        sinks.with_place(df, name).select(F.lit(name).alias("dataset"), "place", item.alias("item"))
        for name, (df, item) in frames.items()])


def _appended_store(spark, sf_dir) -> str:
    """An order store of the history to which the current file, two months of it known, is appended."""
    # landed once: both appends read the normalized lines, not the joins behind them
    path = RD.land_as_parquet(L.load_orders(A.sales_raw(_tt(spark, sf_dir)), CHANNEL_TH), scratch_path(spark, "order-lines"))
    orders = spark.read.parquet(path)
    store = scratch_path(spark, "order-store")
    OS.append(spark, store, orders.filter(F.col("purchase_date") < F.lit(A.APPEND_HISTORY_END)))
    OS.append(spark, store, orders.filter(F.col("purchase_date") >= F.lit(A.APPEND_CURRENT_START)))
    return store


def q_append_then_model(spark, sf_dir):
    """F5 by month into a store, then I3 from the store's lines."""
    i = inputs(spark, sf_dir)
    i.orders = OS.lines(spark, _appended_store(spark, sf_dir))
    return M.loss_detail(i, A.test_config()).drop("channel")


def q_append_then_model_by_month(spark, sf_dir):
    """E4-E8 from the sums that the store keeps per month: the same detail without a line read."""
    i = inputs(spark, sf_dir)
    i.orders = OS.sums(spark, _appended_store(spark, sf_dir))
    return M.loss_detail(i, A.test_config()).drop("channel")


def q_orders_export_utf16(spark, sf_dir):
    """A1 through files: a UTF-16 export whose quoted names hold tabs, quotes and line ends.

    As UTF-16 the lines take many times the tables' size, so the export is kept compressed, in parts that are no
    larger than a split of plain text.
    """
    raw = A.sales_raw(_tt(spark, sf_dir))
    name = F.concat(F.lit('12"\t'), F.col("Product Name"), F.lit('\n"second" line\nกระเป๋า'))
    text = raw.select(F.date_format("Purchase Date", "dd.MM.yyyy").alias("Purchase Date"), "Sku", "stock",
                      F.format_number("Quantity", 2).alias("Quantity"), F.format_number("Gross", 2).alias("Gross"),
                      F.format_number("Net", 4).alias("Net"), name.alias("Product Name"))
    path = scratch_path(spark, "orders-export")
    (text.write.option("header", True).option("sep", "\t").option("encoding", "UTF-16LE").option("lineSep", "\n")
     .option("compression", "gzip").option("maxRecordsPerFile", EXPORT_PART_LINES).options(**RD.QUOTING).csv(path))
    # landed once: the date texts and the rows are both read from the records
    records = RD.read_orders_export(spark, path, quoted_newlines=True).drop("row_ord")
    landed = spark.read.parquet(RD.land_as_parquet(records, scratch_path(spark, "orders-records")))
    return _plain_orders(L.load_orders(landed, CHANNEL_TH))


def _sheet(df: DataFrame, folder: str, sheet: str) -> None:
    """A sheet of a workbook folder, in as many parts as the table has."""
    df.write.option("header", True).options(**RD.QUOTING).csv(RD.sheet_path(folder, sheet))


def q_workbook_inputs(spark, sf_dir):
    """A2 + A9 + A12 + A13 through files: orders from the first sheet of a workbook folder, the site map
    from its sheet Include, products without status from a text file (B16) and stock by month, read as
    the batch run reads them, put up as views and joined in SQL."""
    tt = _tt(spark, sf_dir)
    books, products, stock = (scratch_path(spark, n) for n in ("books", "products", "stock"))
    dated = A.sales_raw(tt).withColumn("Purchase Date", F.date_format("Purchase Date", "yyyy-MM-dd"))
    _sheet(dated, f"{books}/orders", "Orders")
    _sheet(A.site_map_raw(tt), f"{books}/sites", J.SITE_MAP_SHEET)
    A.product_raw(tt).drop("row_ord", "status").write.option("header", True).options(**RD.QUOTING).csv(products)
    RD.land_stock_by_month(A.stock_raw(tt), stock)
    paths = J.InputPaths(orders=f"{books}/orders", daily_stock=stock, site_mapping=f"{books}/sites", product=products,
                         channel=CHANNEL_TH, format="workbook", formats={"daily_stock": "parquet", "product": "text"})
    found = J.load_inputs(spark, paths, site_profile=A.TEST_CHANNEL)
    prefix = "w" + uuid.uuid4().hex[:8] + "_"
    J.register_views(found, prefix)
    months = J.suggest_month_from_path(spark, stock, "parquet")
    return spark.sql(f"""
        SELECT p.sku, p.product_name, p.status, o.lines, cast(o.quantity AS double) AS quantity, o.sites
        FROM {prefix}product p JOIN (
          SELECT sku, count(*) AS lines, sum(quantity) AS quantity, count(DISTINCT stock_code) AS sites FROM {prefix}orders
          WHERE stock_code IN (SELECT virtual_site FROM {prefix}site_map) GROUP BY sku) o ON o.sku = p.sku
        """).withColumn("stock_months", months.select(F.size(F.split("month_hints", ","))).scalar())


def q_snapshot_files(spark, sf_dir):
    """I9 as a job: A10 SKU list from a CSV, K4 rows per channel in a folder named by the dates, H7 order,
    K5 summary set; what is in the files against what the summary says."""
    tt = _tt(spark, sf_dir)
    skus, out = scratch_path(spark, "sku-list"), scratch_path(spark, "snapshot")
    A.snapshot_sku_filter(tt).write.option("header", True).options(**RD.QUOTING).csv(skus)
    job = SJ.run_snapshot_job(spark, A.warehouse_stock(tt), A.snapshot_channel_sites(tt), RD.read_delimited(spark, skus),
                              A.SNAPSHOT_START, A.SNAPSHOT_END, out, csv=True, sheet_name="Live SKUs", input_path="sku list")
    rows = spark.read.option("header", True).options(**RD.QUOTING).csv(f"{job.rows_path}_csv")
    at = F.struct(RD.natural_name(F.col("_metadata.file_path")).alias("file"), F.monotonically_increasing_id().alias("line"))
    key = F.struct("posting_date", "location", "article_code")
    before = F.lag(key).over(Window.partitionBy("channel", "file").orderBy("at"))
    ordered = rows.select("channel", "posting_date", "location", "article_code", "stock_balance", at.alias("at"),
                          F.col("_metadata.file_path").alias("file")).withColumn("in_order", F.coalesce(before <= key, F.lit(True)))
    files = ordered.groupBy("channel").agg(
        F.count(F.lit(1)).alias("file_rows"), F.sum(F.col("stock_balance").cast("decimal(38,2)")).cast("double").alias("balance"),
        F.every("in_order").alias("in_order"))
    folder = SJ.snapshot_folder("", A.SNAPSHOT_START, A.SNAPSHOT_END).strip("/")
    return (job.summary.join(files, "channel", "left")
            .select("channel", "label", "sheet_name", "input_path", "sku_count", "site_code_count", "row_count",
                    F.coalesce("file_rows", F.lit(0)).alias("file_rows"), F.coalesce("balance", F.lit(0.0)).alias("balance"),
                    "in_order", F.regexp_extract("output_csv_path", "/([^/]*)/rows_csv/", 1).alias("folder"),
                    (F.lit(folder) == F.regexp_extract("output_csv_path", "/([^/]*)/rows_csv/", 1)).alias("named_by_dates")))


def q_summary_csv(spark, sf_dir):
    """K2 + K6 + B32: the site summary exported in its order under the run's name, and read back."""
    name = sinks.output_name(A.TEST_CHANNEL, A.test_config().period)
    path = f"{scratch_path(spark, 'export')}/{name}/summary_site_csv"
    sinks.export_csv(R.summary_site(_one_channel_detail(spark, sf_dir)), path, "summary_site")
    rows = RD.read_delimited(spark, path)
    return rows.select(F.lit(name).alias("run"), "virtual_site", *[
        F.col(c).cast("double").alias(c) for c in rows.columns if c != "virtual_site"])


def q_input_findings_paths(spark, sf_dir):
    """I4 by path: no path, nothing there, a format that is none and a file that is not what is said."""
    tt = _tt(spark, sf_dir)
    text, stock = scratch_path(spark, "site-text"), scratch_path(spark, "stock")
    A.site_map_raw(tt).write.option("header", True).csv(text)
    A.stock_raw(tt).write.parquet(stock)
    cases = {
        "absent": J.InputPaths(orders="", daily_stock=stock, site_mapping=text, product=f"{text}-none", channel=CHANNEL_TH,
                               formats={"daily_stock": "parquet"}),
        "broken": J.InputPaths(orders=stock, daily_stock=stock, site_mapping=text, product=text, channel=CHANNEL_TH,
                               formats={"orders": "xls", "daily_stock": "parquet", "product": "parquet"}),
    }
    return reduce(DataFrame.unionByName, [
        J.check_paths(spark, p).where("code not like 'site_mapping%'").select(F.lit(name).alias("case"), "dataset", "severity", "code")
        for name, p in cases.items()])


def q_failed_run(spark, sf_dir):
    """A run whose site map knows no site of the channel fails, and says so in the run log."""
    tt = _tt(spark, sf_dir)
    folder = scratch_path(spark, "failed")
    A.sales_raw(tt).write.parquet(f"{folder}/orders")
    A.stock_raw(tt).write.parquet(f"{folder}/stock")
    A.site_map_raw(tt).write.parquet(f"{folder}/sites")
    A.product_raw(tt).write.parquet(f"{folder}/products")
    paths = J.InputPaths(orders=f"{folder}/orders", daily_stock=f"{folder}/stock", site_mapping=f"{folder}/sites",
                         product=f"{folder}/products", channel=CHANNEL_TH, format="parquet")
    try:
        J.run_from_paths(spark, paths, A.test_config(), f"{folder}/out", csv=False, run_log=f"{folder}/log")
    except ValueError:
        pass
    return spark.read.parquet(f"{folder}/log").drop("logged_at")


def _broken_stock(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A stock file in which lines of some sites lack a field, have one more, or a letter of another encoding."""
    raw = A.stock_raw(_tt(spark, sf_dir))
    kind = F.col("site_code").cast("int") % 10
    fields = [F.date_format("posting_date", "yyyy-MM-dd"), F.col("site_code"),
              F.when(kind == 2, F.concat("article_code", F.lit("é"))).otherwise(F.concat(F.lit('"'), "article_code", F.lit('"')))]
    line = F.when(kind == 0, F.concat_ws(",", *fields)).when(
        kind == 1, F.concat_ws(",", *fields, F.col("stock_balance").cast("string"), F.lit("x"))).otherwise(
        F.concat_ws(",", *fields, F.col("stock_balance").cast("string")))
    path = scratch_path(spark, "stock-lines")
    (raw.select(line.alias("posting_date,site_code,article_code,stock_balance")).write.option("header", True)
     .option("sep", "\x01").option("quote", "\x00").option("encoding", "ISO-8859-1").csv(path))
    return RD.land_checked(spark, path, scratch_path(spark, "stock-checked"))


def q_rejected_lines(spark, sf_dir):
    """I4 + A6: the findings of a file with broken lines, by the lines set aside."""
    return Q.rejected_findings(_broken_stock(spark, sf_dir)[1], "stock")


def q_day_balance_checked(spark, sf_dir):
    """A6 + E1 from the good lines of the same file."""
    i = inputs(spark, sf_dir)
    stock = L.load_daily_stock(_broken_stock(spark, sf_dir)[0])
    return (K.day_balance(stock, i.site_map, A.test_config())
            .select("posting_date", "sku", "virtual_site", F.col("stock_balance").cast("double").alias("stock_balance")))


def q_loss_detail_bucketed(spark, sf_dir):
    """I3 from stock and order lines stored in buckets by SKU: the stock side is not exchanged."""
    i = inputs(spark, sf_dir)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    i.stock = RD.land_by_sku(i.stock, scratch_path(spark, "stock-by-sku"), buckets)
    i.orders = RD.land_by_sku(i.orders, scratch_path(spark, "orders-by-sku"), buckets)
    return M.loss_detail(i, A.test_config()).drop("channel")


QUERIES: dict[str, QueryFn] = {
    "clean_ids": q_clean_ids,
    "parse_numbers": q_parse_numbers,
    "parse_dates_best": q_parse_dates_best,
    "site_map": q_site_map,
    "site_map_expanded": q_site_map_expanded,
    "site_map_status": q_site_map_status,
    "product_first": q_product_first,
    "product_ranked_merge": q_product_ranked_merge,
    "product_name_column": q_product_name_column,
    "orders_norm": q_orders_norm,
    "orders_append_distinct": q_orders_append_distinct,
    "universe": q_universe,
    "universe_no_live": q_universe_no_live,
    "day_balance": q_day_balance,
    "oos_days": q_oos_days,
    "window_sales": q_window_sales,
    "baseline": q_baseline,
    "unit_price": q_unit_price,
    "loss_detail": q_loss_detail,
    "loss_detail_two_channels": q_loss_detail_two_channels,
    "loss_detail_toggles_off": q_loss_detail_toggles_off,
    "loss_detail_feb": q_loss_detail_feb,
    "unmapped_sites": q_unmapped_sites,
    "summary_total": q_summary_total,
    "summary_site": q_summary_site,
    "summary_sku_pivot": q_summary_sku_pivot,
    "top_sites": q_top_sites,
    "top_skus": q_top_skus,
    "calc_example": q_calc_example,
    "qa_summary": q_qa_summary,
    "input_profile": q_input_profile,
    "input_findings": q_input_findings,
    "quality_gate": q_quality_gate,
    "month_suggestion": q_month_suggestion,
    "overview_totals": q_overview_totals,
    "overview_trust": q_overview_trust,
    "input_fingerprint": q_input_fingerprint,
    "run_record": q_run_record,
    "stock_snapshot": q_stock_snapshot,
    "snapshot_summary": q_snapshot_summary,
    "results_round_trip": q_results_round_trip,
    "loss_detail_own_inputs": q_loss_detail_own_inputs,
    "unmapped_sites_two_channels": q_unmapped_sites_two_channels,
    "channel_keys": q_channel_keys,
    "text_round_trip": q_text_round_trip,
    "report_order": q_report_order,
    "append_then_model": q_append_then_model,
    "append_then_model_by_month": q_append_then_model_by_month,
    "orders_export_utf16": q_orders_export_utf16,
    "workbook_inputs": q_workbook_inputs,
    "snapshot_files": q_snapshot_files,
    "summary_csv": q_summary_csv,
    "input_findings_paths": q_input_findings_paths,
    "failed_run": q_failed_run,
    "rejected_lines": q_rejected_lines,
    "day_balance_checked": q_day_balance_checked,
    "loss_detail_bucketed": q_loss_detail_bucketed,
    "input_findings_broken": q_input_findings_broken,
    "quality_gate_broken": q_quality_gate_broken,
    "input_staleness": q_input_staleness,
}
