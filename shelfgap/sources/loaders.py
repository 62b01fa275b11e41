"""Normalize raw inputs into the four logical tables (SURVEY §1.2, A3, A7, A8,
A16, B1-B16, C1-C4, F1-F3, F5-F7, I14, I15).

Each loader is ``DataFrame -> DataFrame`` and lazy, but for the landed dictionary of
the date texts of orders and stock.  Raw frames carry the
reference's raw column names; text columns are typed with ``try_cast`` and
typed columns (Parquet) are kept as they are.  An optional ``row_ord`` column
on a raw frame stands for file order and breaks "first row" ties.

Logical schemas:
  site_map    channel, site_code, virtual_site
  product     sku, product_name, status, excluded_prefix_p
  orders      purchase_date, sku, stock_code, quantity, gross, net, product_name,
              excluded_prefix_p [, row_ord] [, purchase_month when month-partitioned]
  daily_stock posting_date, site_code, sku, stock_balance, location, excluded_prefix_p
              [, posting_month when read from a month-partitioned store]
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions.dates import to_day, with_best_timestamp, with_month_first_timestamp
from ..profiles import CHANNEL_TH, STOCK_CODE_REPLACE, ChannelProfile, get_profile
from .contracts import (SHEET_PRODUCT_COLUMNS, SHEET_SALES_COLUMNS, SHEET_SALES_RENAME,
                        SITE_MAP_COLUMNS, STOCK_COLUMNS, TH_PRODUCT_COLUMNS, TH_SALES_COLUMNS,
                        product_name_column, require_columns)


def _profiles(channels) -> list[ChannelProfile]:
    if isinstance(channels, (str, ChannelProfile)):
        channels = [channels]
    return [get_profile(c) for c in channels]


# ---------------------------------------------------------------- site map --
def active_site_rows(raw: DataFrame) -> DataFrame:
    """C1 + B1 + B4 + C2: active rows with clean (site_code, virtual_site)."""
    require_columns(raw, SITE_MAP_COLUMNS, "Site mapping")
    return (raw
            .filter(C.active_flag("Active") == "X")
            .select(C.clean_id("Site", raw.schema["Site"].dataType).alias("site_code"),
                    C.normalize_virtual_site("Virtual Location").alias("virtual_site"))
            .filter((F.col("site_code") != "") & (F.col("virtual_site") != "")))


def expand_virtual_sites(rows: DataFrame, channel_col: str = "channel",
                         profiles: list[ChannelProfile] | None = None) -> DataFrame:
    """each (src -> dst) pair of the row's channel adds a copy of the row under dst.

    Written as one ``explode`` of [site, copies...] instead of a union of
    filtered copies: one narrow pass, no join.
    """
    copies = [F.col("virtual_site")]
    for p in profiles or []:
        for src, dst in p.site_copies:
            copies.append(F.when((F.col(channel_col) == p.key) & (F.col("virtual_site") == src),
                                 F.lit(dst)))
    if len(copies) == 1:
        return rows
    return (rows.withColumn("virtual_site", F.explode(F.array(*copies)))
            .filter(F.col("virtual_site").isNotNull()))


def allowed_site_filter(profiles: list[ChannelProfile], channel_col: str = "channel"):
    """Per channel, keep its allowed virtual sites; an empty list keeps all."""
    cond = F.lit(False)
    for p in profiles:
        this = F.col(channel_col) == p.key
        if p.sites:
            this = this & F.col("virtual_site").isin(list(p.sites))
        cond = cond | this
    return cond


def load_site_map(raw: DataFrame, channels=CHANNEL_TH) -> DataFrame:
    """Active -> clean -> per-channel expand -> allowed -> distinct.

    Output (channel, site_code, virtual_site).  Several channels are one plan:
    every raw row is fanned out to the (few) requested channels.
    """
    profiles = _profiles(channels)
    rows = active_site_rows(raw)
    rows = rows.withColumn("channel", F.explode(F.array(*[F.lit(p.key) for p in profiles])))
    rows = expand_virtual_sites(rows, "channel", profiles)
    rows = rows.filter(allowed_site_filter(profiles))
    return rows.select("channel", "site_code", "virtual_site").dropDuplicates(
        ["channel", "site_code", "virtual_site"])


# ----------------------------------------------------------------- product --
def _with_row_ord(raw: DataFrame) -> F.Column:
    return F.col("row_ord") if "row_ord" in raw.columns else F.lit(None).cast("long")


def load_product_list(raw: DataFrame) -> DataFrame:
    """A7 + B11 + B16 + F1: product CSV of the base channel, first row per sku kept.

    "First" is the lowest ``row_ord`` (file order); without it the smallest
    (name, status) wins so the result is still deterministic.  The dedup is an
    aggregate (``min_by``) rather than a window, so a sku repeated on a third
    of the rows is combined map-side instead of landing in one task.
    """
    require_columns(raw, TH_PRODUCT_COLUMNS, "Product file")
    name = (F.col("productName").cast("string") if "productName" in raw.columns else F.lit(""))
    status = C.normalize_status("status") if "status" in raw.columns else F.lit("unknown")
    rows = (raw.select(C.clean_id("skuNo", raw.schema["skuNo"].dataType).alias("sku"), name.alias("product_name"),
                       status.alias("status"), _with_row_ord(raw).alias("row_ord"))
            .filter(F.col("sku") != ""))
    order_key = F.struct(F.col("row_ord").alias("o"),
                         F.col("product_name"), F.col("status"))
    picked = rows.groupBy("sku").agg(
        F.min_by(F.struct("product_name", "status"), order_key).alias("r"))
    return picked.select("sku", "r.product_name", "r.status",
                         C.is_excluded_sku("sku").alias("excluded_prefix_p"))


def product_sheet_rows(sheet: DataFrame, sheet_name: str) -> DataFrame:
    """One product sheet -> (sku, product_name, status, sheet_name, row_ord)."""
    require_columns(sheet, SHEET_PRODUCT_COLUMNS, f"Product workbook sheet '{sheet_name}'")
    return sheet.select(C.clean_id("SKU CODE", sheet.schema["SKU CODE"].dataType).alias("sku"),
                        product_name_column(sheet).alias("product_name"),
                        C.normalize_status("WEB STATUS").alias("status"),
                        F.lit(sheet_name).alias("sheet_name"),
                        _with_row_ord(sheet).alias("row_ord"))


def merge_ranked_products(sheets: dict[str, DataFrame]) -> DataFrame:
    """I14 = F7 + B13 + B14 + F2: union the sheets, keep per sku the best row by
    status rank desc, name present desc, sheet name asc (then file order)."""
    rows = reduce(DataFrame.unionByName,
                  [product_sheet_rows(df, name) for name, df in sheets.items()])
    rows = rows.filter(F.col("sku") != "")
    rank_key = F.struct(
        (-C.status_rank("status")).alias("s"),
        (-C.nonblank_flag("product_name")).alias("n"),
        F.col("sheet_name").alias("sheet"),
        F.col("row_ord").alias("o"),
        F.col("product_name").alias("name"))
    picked = rows.groupBy("sku").agg(
        F.min_by(F.struct("product_name", "status"), rank_key).alias("r"))
    return picked.select("sku", "r.product_name", "r.status",
                         C.is_excluded_sku("sku").alias("excluded_prefix_p"))


def load_products(raw_or_sheets, channel=CHANNEL_TH) -> DataFrame:
    profile = get_profile(channel)
    if not profile.sheets_of("sku_live"):
        return load_product_list(raw_or_sheets)
    missing = [s for s in profile.sheets_of("sku_live") if s not in raw_or_sheets]
    if missing:
        raise ValueError(f"Product workbook missing sheets for {profile.label}: {missing}")
    return merge_ranked_products({s: raw_or_sheets[s] for s in profile.sheets_of("sku_live")})


# ------------------------------------------------------------------ orders --
def rename_sheet_orders(raw: DataFrame) -> DataFrame:
    """A3: sheet columns -> canonical order-export names."""
    require_columns(raw, SHEET_SALES_COLUMNS, "Order workbook sheet")
    return raw.withColumnsRenamed(SHEET_SALES_RENAME)


def load_orders(raw: DataFrame, channel=CHANNEL_TH) -> DataFrame:
    """A3 + B5 + B6 + B8 + C2 + C4: normalized order lines."""
    if get_profile(channel).sheets_of("sales"):
        raw = rename_sheet_orders(raw)
    require_columns(raw, TH_SALES_COLUMNS, "OrderDetail")
    types = {f.name: f.dataType for f in raw.schema.fields}
    raw = with_best_timestamp(raw, "Purchase Date", "_purchase_date")
    cols = [
        F.col("_purchase_date").alias("purchase_date"),
        C.clean_id("Sku", types["Sku"]).alias("sku"),
        C.normalize_stock_code("stock", STOCK_CODE_REPLACE).alias("stock_code"),
        C.parse_number("Quantity", types["Quantity"]).alias("quantity"),
        C.parse_number("Gross", types["Gross"]).alias("gross"),
        C.parse_number("Net", types["Net"]).alias("net"),
        F.col("Product Name").cast("string").alias("product_name"),
    ]
    for extra in ("row_ord", "purchase_month"):   # file order / month-partition column
        if extra in raw.columns:
            cols.append(F.col(extra))
    out = raw.select(*cols).filter(F.col("purchase_date").isNotNull() & (F.col("sku") != ""))
    return out.withColumn("excluded_prefix_p", C.is_excluded_sku("sku"))


def append_orders(history: DataFrame, current: DataFrame) -> DataFrame:
    """UNION DISTINCT of two normalized order tables on all columns.

    Like the reference this also collapses repeated identical lines.  It is a
    hash aggregate with a map-side combine.  File order, where both tables have
    it, is no part of a line's identity: the first place of a line is kept, and
    the history comes before the current file.
    """
    cols = [c for c in history.columns if c not in ("row_ord", "purchase_month")]
    if not {"row_ord"} <= set(history.columns) & set(current.columns):
        return history.select(*cols).unionByName(current.select(*cols)).distinct()
    place = F.struct(F.lit(0).alias("file"), "row_ord")
    later = F.struct(F.lit(1).alias("file"), "row_ord")
    both = (history.select(*cols, place.alias("row_ord"))
            .unionByName(current.select(*cols, later.alias("row_ord"))))
    return both.groupBy(*cols).agg(F.min("row_ord").alias("row_ord"))


def for_channel(df: DataFrame, channel) -> DataFrame:
    """The frame as one channel's own: inputs of several channels are unioned after this."""
    return df.withColumn("channel", F.lit(get_profile(channel).key))


# ------------------------------------------------------------------- stock --
def load_daily_stock(raw: DataFrame) -> DataFrame:
    """Normalized daily stock rows (date truncated to the day).

    Deviation: ``site_code`` gets the same ``clean_id`` as the site map (the
    reference only strips it, so '1110.0' would not match '1110').
    """
    require_columns(raw, STOCK_COLUMNS, "Daily stock file")
    types = {f.name: f.dataType for f in raw.schema.fields}
    location = F.col("location").cast("string") if "location" in raw.columns else F.lit("")
    # a month-partitioned store keeps its partition column for pruning
    extra = [F.col("posting_month")] if "posting_month" in raw.columns else []
    raw = with_month_first_timestamp(raw, "posting_date", "_posting_date")
    out = raw.select(
        to_day(F.col("_posting_date")).alias("posting_date"),
        C.clean_id("site_code", types["site_code"]).alias("site_code"),
        C.clean_id("article_code", types["article_code"]).alias("sku"),
        C.parse_number("stock_balance", types["stock_balance"], strip_commas=False)
        .alias("stock_balance"),
        location.alias("location"),
        *extra,
    ).filter(F.col("posting_date").isNotNull() & (F.col("sku") != ""))
    return out.withColumn("excluded_prefix_p", C.is_excluded_sku("sku"))
