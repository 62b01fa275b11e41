"""Multi-channel daily stock snapshot (SURVEY A10-A12, B18, B33, C11, D11, E15,
E20, F8, H7, I9).

The reference runs one SQL query per channel with a formatted site list and a
temp view of the SKU list, then ``toPandas``.  Here all channels are one plan:
the warehouse table is range-filtered on the date (pushed to the scan),
joined with the (channel, site_code) dimension -- which also adds the channel
column -- and semi-joined with the SKU list.  Nothing is collected.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cleaning import blank_to_empty
from ..profiles import label_column
from ..sources.contracts import resolve_article_code_column

SNAPSHOT_KEYS = ["posting_date", "site_code", "location", "article_code",
                 "latest_article_description"]


def channel_sites_from_lists(spark: SparkSession, site_codes: dict[str, list[str]]) -> DataFrame:
    """Fixed per-channel site lists (parameters) -> (channel, site_code) dimension."""
    rows = [(ch, str(code)) for ch, codes in site_codes.items()
            for code in dict.fromkeys(codes)]
    return spark.createDataFrame(rows, T.StructType([
        T.StructField("channel", T.StringType(), False),
        T.StructField("site_code", T.StringType(), False)]))


def sku_filter_table(sku_list: DataFrame) -> DataFrame:
    """A10 + B18 + B33 + F8: resolve the article column, strip, drop blanks, distinct."""
    art = resolve_article_code_column(sku_list)
    keys = ["channel"] if "channel" in sku_list.columns else []
    return (sku_list.select(*keys, blank_to_empty(art).alias("article_code"))
            .filter(F.col("article_code") != "").distinct())


def stock_snapshot(warehouse: DataFrame, channel_sites: DataFrame, sku_list: DataFrame,
                   start: dt.date, end: dt.date) -> DataFrame:
    """I9 core: Σ stock_balance per (channel, date, site, location, article, description)
    for dates BETWEEN start AND end, the channel's sites and listed SKUs.

    Ordering (H7: date, location, article) is applied by the sink.
    """
    skus = sku_filter_table(sku_list)
    sites = channel_sites.select("channel", "site_code").distinct()
    s = (warehouse.filter(F.col("posting_date").between(F.lit(start), F.lit(end)))
         .select(*SNAPSHOT_KEYS, "stock_balance"))
    j = s.join(sites, "site_code")
    sku_keys = ["channel", "article_code"] if "channel" in skus.columns else ["article_code"]
    j = j.join(skus, sku_keys, "left_semi")
    return (j.groupBy("channel", *SNAPSHOT_KEYS)
            .agg(F.sum("stock_balance").cast("double").alias("stock_balance")))


def snapshot_summary(snapshot: DataFrame, channel_sites: DataFrame, sku_list: DataFrame,
                     sheet_name: str = "", input_path: str = "", output_root: str = "") -> DataFrame:
    """One row per channel -- its label, SKU, site-code and row counts, and where its
    SKU list came from (sheet and path) and its rows went (a folder per channel)."""
    skus = sku_filter_table(sku_list)
    sites = (channel_sites.select("channel", "site_code").distinct()
             .groupBy("channel").agg(F.count(F.lit(1)).alias("site_code_count")))
    rows = snapshot.groupBy("channel").agg(F.count(F.lit(1)).alias("row_count"))
    if "channel" in skus.columns:
        sku_counts = skus.groupBy("channel").agg(F.count(F.lit(1)).alias("sku_count"))
        out = sites.join(sku_counts, "channel", "left")
    else:
        out = sites.withColumn("sku_count", skus.select(F.count(F.lit(1))).scalar())
    out = out.join(rows, "channel", "left")
    folder = F.concat(F.lit(f"{output_root.rstrip('/')}/channel="), F.col("channel"))
    return out.select("channel", label_column(F.col("channel")).alias("label"),
                      F.lit(sheet_name).alias("sheet_name"),
                      F.coalesce("sku_count", F.lit(0)).cast("long").alias("sku_count"),
                      F.col("site_code_count").cast("long").alias("site_code_count"),
                      F.coalesce("row_count", F.lit(0)).cast("long").alias("row_count"),
                      F.lit(input_path).alias("input_path"),
                      (folder if output_root else F.lit("")).alias("output_csv_path"))
