"""Derive the four raw inputs from the driver's TPC-H-style test tables.

The test tables carry no daily stock or site map, so they are derived
(FIXTURES.md §4): regions act as virtual sites, suppliers as site codes,
parts as SKUs, line items as order lines and as daily stock movements.  The
derivation is ordinary Spark joins over the whole tables.  Suppliers with their
regions are broadcast up to a checked count, so that line items are not moved
for them; the other dimension sides (nation, region, part) are left to the
planner, which broadcasts them only when their measured size is under the
broadcast threshold.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..profiles import ChannelProfile, ModelConfig

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

# --- fixed values of the test adapter ---------------------------------------
EVAL_YEAR, EVAL_MONTH = 1998, 6          # evaluation month used by every query
SNAPSHOT_START = dt.date(1998, 6, 1)     # snapshot range (BETWEEN, inclusive)
SNAPSHOT_END = dt.date(1998, 6, 30)
APPEND_HISTORY_END = dt.date(1998, 7, 1)   # orders part 1: before this day
APPEND_CURRENT_START = dt.date(1998, 5, 1)  # orders part 2: from this day (overlap collapses)
# A profile with no allowed-site list (regions are the virtual sites).
TEST_CHANNEL = ChannelProfile(key="tpch", label="TPCH")
# Second channel: 'asia' is copied to 'asia-online'; only three sites allowed.
TEST_CHANNEL_2 = ChannelProfile(key="tpch2", label="TPCH2",
                                sites=("asia", "asia-online", "europe"),
                                site_copies=(("asia", "asia-online"),))
# ---------------------------------------------------------------------------


_OPEN: dict[str, "TestTables"] = {}


def open_tables(spark: SparkSession, sf_dir: str) -> "TestTables":
    """Shared lazy table handles per folder for the current session: each file
    is listed and its footer read once, however many queries use it.  A new
    session (the same object is required, not just an equal id) starts fresh."""
    key = sf_dir
    tt = _OPEN.get(key)
    if tt is None or tt.spark is not spark:
        tt = _OPEN[key] = TestTables(spark, sf_dir)
    return tt


def test_config(**overrides) -> ModelConfig:
    return ModelConfig(eval_year=EVAL_YEAR, eval_month=EVAL_MONTH, **overrides)


@dataclass
class TestTables:
    spark: SparkSession
    sf_dir: str

    def __post_init__(self) -> None:
        self._frames: dict[str, DataFrame] = {}
        self.landed: dict[str, str] = {}     # derived input name -> Parquet path
        self.suppliers: int | None = None    # rows, once counted

    def t(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self._read(name)
        return self._frames[name]

    def landed_frame(self, name: str) -> DataFrame:
        key = f"landed:{name}"
        if key not in self._frames:
            self._frames[key] = self.spark.read.parquet(self.landed[name])
        return self._frames[key]

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir.rstrip('/')}/{name}.parquet")


def sku_of(p_type: Column, p_partkey: Column) -> Column:
    """Promo parts get the excluded 'P' prefix, all others 'K'."""
    return F.concat(F.when(p_type == "PROMO", "P").otherwise("K"), p_partkey.cast("string"))


def _signed(negative: Column, value: Column) -> Column:
    """value, negated where ``negative`` (keeps the decimal type compact)."""
    return F.when(negative, -value).otherwise(value)


BROADCAST_SUPPLIERS = 1_000_000     # rows of key and region name that are sent to the tasks


def _few_suppliers(tt: TestTables) -> bool:
    if tt.suppliers is None:
        tt.suppliers = tt.t("supplier").count()      # from the file's footer
    return tt.suppliers <= BROADCAST_SUPPLIERS


def _supplier_region(tt: TestTables) -> DataFrame:
    s = tt.t("supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    n = tt.t("nation").select("n_nationkey", "n_name", "n_regionkey")
    r = tt.t("region").select("r_regionkey", "r_name")
    return (s.join(n, s.s_nationkey == n.n_nationkey)
            .join(r, n.n_regionkey == r.r_regionkey))


def site_map_raw(tt: TestTables) -> DataFrame:
    """Virtual Location = region, Site = supplier key, Active from the balance."""
    sr = _supplier_region(tt)
    return sr.select(
        F.replace(F.col("r_name"), F.lit(" "), F.lit("-")).alias("Virtual Location"),
        F.col("s_suppkey").cast("string").alias("Site"),
        F.when(F.col("s_acctbal") >= 1000, "X").when(F.col("s_acctbal") >= 500, " x ")
        .otherwise("").alias("Active"))


def product_raw(tt: TestTables) -> DataFrame:
    """skuNo / productName / status; sizes divisible by 3 are hidden."""
    p = tt.t("part")
    return p.select(
        sku_of(F.col("p_type"), F.col("p_partkey")).alias("skuNo"),
        F.col("p_name").alias("productName"),
        F.when(F.col("p_size") % 3 == 0, "hide").otherwise("live").alias("status"),
        F.col("p_partkey").alias("row_ord"))


def product_sheets_raw(tt: TestTables) -> dict[str, DataFrame]:
    """Two product sheets for the ranked merge (F2).

    click&collect: every part, status as in ``product_raw``.
    HomeDelivery: parts larger than size 25, live for SMALL/LARGE types,
    name blank for three brands -- so status, name and sheet ties all occur.
    """
    p = tt.t("part")
    sku = sku_of(F.col("p_type"), F.col("p_partkey"))
    a = p.select(sku.alias("SKU CODE"), F.col("p_name").alias("DESCRIPTION"),
                 F.when(F.col("p_size") % 3 == 0, " Hide ").otherwise("LIVE").alias("WEB STATUS"),
                 F.col("p_partkey").alias("row_ord"))
    b = (p.filter(F.col("p_size") > 25)
         .select(sku.alias("SKU CODE"),
                 F.when(F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3"), F.lit(""))
                 .otherwise(F.concat(F.col("p_name"), F.lit(" HD"))).alias("DESCRIPTION"),
                 F.when(F.col("p_type").isin("SMALL", "LARGE"), "live").otherwise("hide")
                 .alias("WEB STATUS"),
                 F.col("p_partkey").alias("row_ord")))
    return {"click&collect": a, "HomeDelivery": b}


def sales_raw(tt: TestTables) -> DataFrame:
    if "sales_raw" in tt.landed:
        return tt.landed_frame("sales_raw")
    return _sales_raw(tt)


def _sales_raw(tt: TestTables) -> DataFrame:
    """One order line per line item; returns (flag R) are negative."""
    li = tt.t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity",
                                 "l_extendedprice", "l_discount", "l_returnflag")
    o = tt.t("orders").select("o_orderkey", "o_orderdate")
    p = tt.t("part").select("p_partkey", "p_type", "p_name")
    sr = _supplier_region(tt).select("s_suppkey", "r_name")
    if _few_suppliers(tt):
        sr = F.broadcast(sr)
    j = (li.join(o, li.l_orderkey == o.o_orderkey)
         .join(p, li.l_partkey == p.p_partkey)
         .join(sr, li.l_suppkey == sr.s_suppkey))
    is_return = F.col("l_returnflag") == "R"
    qty = F.col("l_quantity").cast("decimal(18,2)")
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    gross = F.when(is_return, -price).otherwise(price)
    return j.select(
        F.col("o_orderdate").cast("date").alias("Purchase Date"),
        sku_of(F.col("p_type"), F.col("p_partkey")).alias("Sku"),
        F.lower(F.replace(F.col("r_name"), F.lit(" "), F.lit("-"))).alias("stock"),
        F.when(is_return, -qty).otherwise(qty).alias("Quantity"),
        gross.alias("Gross"),
        (gross * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)")))
        .cast("decimal(18,4)").alias("Net"),
        F.col("p_name").alias("Product Name"))


def stock_raw(tt: TestTables) -> DataFrame:
    if "stock_raw" in tt.landed:
        return tt.landed_frame("stock_raw")
    return _stock_raw(tt)


def _stock_raw(tt: TestTables) -> DataFrame:
    """Daily stock movement per (ship date, supplier, part); open lines are negative."""
    li = tt.t("lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_linestatus",
                                 "l_shipdate")
    p = tt.t("part").select("p_partkey", "p_type")
    j = li.join(p, li.l_partkey == p.p_partkey)
    return j.select(
        F.col("l_shipdate").cast("date").alias("posting_date"),
        F.col("l_suppkey").cast("string").alias("site_code"),
        sku_of(F.col("p_type"), F.col("p_partkey")).alias("article_code"),
        _signed(F.col("l_linestatus") != "F", F.col("l_quantity").cast("decimal(18,2)"))
        .alias("stock_balance"))


def warehouse_stock(tt: TestTables) -> DataFrame:
    if "warehouse_stock" in tt.landed:
        return tt.landed_frame("warehouse_stock")
    return _warehouse_stock(tt)


def _warehouse_stock(tt: TestTables) -> DataFrame:
    """Warehouse daily-stock table for the snapshot job (A11): location = supplier
    nation, description = part name."""
    li = tt.t("lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_linestatus",
                                 "l_shipdate")
    p = tt.t("part").select("p_partkey", "p_type", "p_name")
    s = tt.t("supplier").select("s_suppkey", "s_nationkey")
    n = tt.t("nation").select("n_nationkey", "n_name")
    j = (li.join(p, li.l_partkey == p.p_partkey)
         .join(s, li.l_suppkey == s.s_suppkey)
         .join(n, s.s_nationkey == n.n_nationkey))
    return j.select(
        F.col("l_shipdate").cast("date").alias("posting_date"),
        F.col("l_suppkey").cast("string").alias("site_code"),
        F.col("n_name").alias("location"),
        sku_of(F.col("p_type"), F.col("p_partkey")).alias("article_code"),
        F.col("p_name").alias("latest_article_description"),
        _signed(F.col("l_linestatus") != "F", F.col("l_quantity").cast("decimal(18,2)"))
        .alias("stock_balance"))


def snapshot_channel_sites(tt: TestTables) -> DataFrame:
    """(channel, site_code): a channel per region, its suppliers as site codes."""
    sr = _supplier_region(tt)
    return sr.select(F.lower(F.replace(F.col("r_name"), F.lit(" "), F.lit("-"))).alias("channel"),
                     F.col("s_suppkey").cast("string").alias("site_code"))


def snapshot_sku_filter(tt: TestTables) -> DataFrame:
    """SKU list shared by all channels: live products, under an aliased column name."""
    return (product_raw(tt).filter(F.col("status") == "live")
            .select(F.col("skuNo").alias("Article Code")))


def land_inputs(tt: TestTables, root: str) -> dict[str, str]:
    """Write the derived order lines, daily stock and warehouse table once as
    Parquet under ``root`` (the shared folder) and read them from there from
    now on -- the shape real inputs have: stored, splittable tables.  Stock
    tables are range-clustered by date so a month filter skips whole files."""
    cores = int(tt.spark.conf.get("spark.sql.shuffle.partitions", "8"))
    out = {}
    for name, build, order in (("sales_raw", _sales_raw, None),
                               ("stock_raw", _stock_raw, "posting_date"),
                               ("warehouse_stock", _warehouse_stock, "posting_date")):
        path = f"{root.rstrip('/')}/{name}.parquet"
        df = build(tt)
        df = df.repartitionByRange(cores, order) if order else df.repartition(cores)
        df.write.mode("overwrite").parquet(path)
        out[name] = path
    tt.landed.update(out)
    return out
