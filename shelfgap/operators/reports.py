"""Reports over the detail table.

Money and quantity sums over detail rows are accumulated as DECIMAL(28,6)
and cast back to double: the result then does not depend on partitioning or
row order (a plain double sum does), which also makes it comparable across
engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEASURES = ["lost_qty_raw", "lost_value_gross_raw", "lost_value_net_raw", "loss_gross",
            "loss_net"]

# --- fixed values: report labels -------------------------------------------
TOTAL_METRICS = [
    ("Total Lost Qty Raw", "lost_qty_raw"),
    ("Total Lost Value Gross Raw", "lost_value_gross_raw"),
    ("Total Lost Value Net Raw", "lost_value_net_raw"),
]
# ---------------------------------------------------------------------------


def exact_sum(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.sum(col.cast("decimal(28,6)")).cast("double")


def summary_total(detail: DataFrame) -> DataFrame:
    """Three totals as (metric, value) rows."""
    wide = detail.agg(*[F.coalesce(exact_sum(src), F.lit(0.0)).alias(label)
                        for label, src in TOTAL_METRICS])
    return wide.unpivot([], [label for label, _ in TOTAL_METRICS], "metric", "value")


def summary_site(detail: DataFrame) -> DataFrame:
    """Per virtual site -- rows, mean OOS ratio and the five loss sums.

    The mean ratio is Σ oos_days / rows / month days: the same number as the
    mean of the per-row ratios, computed exactly from integers.
    """
    return detail.groupBy("virtual_site").agg(
        F.count(F.lit(1)).alias("sku_site_rows_eval"),
        (F.sum("oos_days_jan").cast("double") / F.count(F.lit(1)).cast("double")
         / F.max("observed_days_jan")).alias("avg_oos_ratio"),
        *[exact_sum(m).alias(m) for m in MEASURES])


def summary_sku(detail: DataFrame, sites: list[str]) -> DataFrame:
    """E12 + E13 + D10: per sku -- name, five sums and loss_net per virtual site.

    The pivot is written as conditional sums in the same aggregation (one
    pass, no join back); ``sites`` fixes the dynamic columns up front.
    """
    pivot = [F.coalesce(F.sum(F.when(F.col("virtual_site") == s, F.col("loss_net"))),
                        F.lit(0.0)).alias(f"loss_net_{s}") for s in sites]
    return detail.groupBy("sku").agg(
        F.min("product_name").alias("product_name"),
        *[exact_sum(m).alias(m) for m in MEASURES], *pivot)


def top_sites(site_summary: DataFrame, k: int = 5) -> DataFrame:
    """H5: the k sites with the largest net loss (ties by site name)."""
    return site_summary.orderBy(F.desc("lost_value_net_raw"), F.asc("virtual_site")).limit(k)


def top_skus(sku_summary: DataFrame, k: int = 5) -> DataFrame:
    """H5: the k SKUs with the largest net loss (ties by sku)."""
    return sku_summary.orderBy(F.desc("lost_value_net_raw"), F.asc("sku")).limit(k)


def _num(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.format_string("%.6f", col.cast("double"))


def calculation_example(detail: DataFrame) -> DataFrame:
    """I7 + H6 + C12: the worked example for the top loss row, 17 (item, formula,
    value) rows; one 'No sample row' row when the detail is empty.

    The top row prefers rows with a positive lost quantity (C12), written as a
    sort key so there is no count action.  Values are text (numbers '%.6f').
    """
    top = detail.orderBy((F.col("lost_qty_raw") > 0).desc(), F.desc("loss_net"),
                         F.asc("sku"), F.asc("virtual_site")).limit(1)
    pre_lost = F.col("baseline_daily_qty") * F.col("oos_days_jan").cast("double")
    items = [
        ("Sample row", "highest loss_net row in Detail",
         F.concat(F.lit("SKU "), F.col("sku"), F.lit(" | Site "), F.col("virtual_site"))),
        ("Input: baseline_source", "-", F.col("baseline_source")),
        ("Input: recent_qty", "-", _num("recent_qty")),
        ("Input: fallback_qty", "-", _num("fallback_qty")),
        ("Input: baseline_window_qty", "-", _num("baseline_qty_window")),
        ("Input: baseline_window_days", "-", _num("baseline_window_days")),
        ("Input: observed_days", "-", _num("observed_days_jan")),
        ("Input: in_stock_days", "-", _num("in_stock_days")),
        ("Input: actual_qty", "-", _num("actual_qty_jan")),
        ("Step 1 baseline_daily_qty", "baseline_window_qty / baseline_window_days",
         _num("baseline_daily_qty")),
        ("Step 2 oos_days", "observed_days - in_stock_days", _num("oos_days_jan")),
        ("Step 3 preliminary_lost_qty", "baseline_daily_qty * oos_days", _num(pre_lost)),
        ("Step 4 apply actual-zero rule",
         "if actual_qty > 0 then lost_qty_raw=0 else keep Step 3", _num("lost_qty_raw")),
        ("Input: net_per_unit", "-", _num("net_per_unit")),
        ("Input: gross_per_unit", "-", _num("gross_per_unit")),
        ("Step 5 loss_net", "lost_qty_raw * net_per_unit", _num("loss_net")),
        ("Step 6 loss_gross", "lost_qty_raw * gross_per_unit", _num("loss_gross")),
    ]
    arr = F.array(*[F.struct(F.lit(i + 1).alias("seq"), F.lit(item).alias("item"),
                             F.lit(formula).alias("formula"), value.alias("value"))
                    for i, (item, formula, value) in enumerate(items)])
    # a global aggregate of the top row: null for an empty detail, whose plan is evaluated once
    none = F.array(F.struct(F.lit(1).alias("seq"), F.lit("No sample row").alias("item"), F.lit("-").alias("formula"),
                            F.lit("Detail sheet is empty").alias("value")))
    row = top.select(arr.alias("a")).agg(F.first("a").alias("a"))
    return row.select(F.explode(F.coalesce("a", none)).alias("r")).select(
        "r.seq", "r.item", "r.formula", "r.value")
