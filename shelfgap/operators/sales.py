"""Sales side of the model: window totals, baseline choice, actual month sales
and unit prices (SURVEY B20, B22, B26, C8, D5, E4-E8).

The reference scans orders three times (recent, fallback, month) and joins
the recent and fallback totals with a full outer join.  Here one aggregation
over (sku, stock_code, product_name) computes every window total as a
conditional sum plus the all-time totals the unit price needs (``sales_lines``).
Two small aggregations over it give the per-sku prices
(``unit_price_from_lines``) and the per-(sku, site) window sums
(``site_sales_from_lines``).  All are keyed by channel too where the orders
carry one.
One scan, one big shuffle with map-side combine, no outer join.

Sums are taken in the input's own numeric type (exact for decimals) and cast
to double once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import safe_div
from ..functions.dates import in_months, in_range
from ..profiles import ModelConfig


def _keys(df: DataFrame) -> list[str]:
    return ["channel"] if "channel" in df.columns else []


def sales_lines(orders: DataFrame, cfg: ModelConfig, with_totals: bool = True) -> DataFrame:
    """The one big aggregation over order lines: per (sku, stock_code, product_name).

    Every window total (E5-E7) is a conditional sum and the all-time totals
    (E4) ride along, so the order lines are scanned and shuffled once, with a
    map-side partial aggregate (a hot sku is combined before the shuffle).
    The product name is a grouping key, not an aggregate buffer, so the
    aggregate stays a hash aggregate (string min/first buffers would force a
    sort-based one).  All measures are packed in one struct column ``m``: both
    consumers (site sales and unit price) then read the identical plan and
    Spark reuses its shuffle instead of recomputing the order lines.
    Without ``with_totals`` the scan is limited to fallback start .. month end,
    which pushes down to the source.

    ``orders`` may also be the monthly sums of an order store: windows start and
    end with months, so the same totals follow from far fewer rows.
    """
    if "month_qty" in orders.columns:
        return _lines_of_months(orders, cfg, with_totals)
    o = orders.filter(~F.col("excluded_prefix_p"))
    if not with_totals:
        o = o.filter(in_range(F.col("purchase_date"), cfg.fallback_start, cfg.next_anchor))
        if "purchase_month" in orders.columns:      # month-partitioned store: prune
            o = o.filter(F.col("purchase_month").between(
                F.lit(cfg.fallback_start.strftime("%Y-%m")), F.lit(cfg.period)))
    d = F.col("purchase_date")
    q = F.col("quantity")
    in_recent = in_range(d, cfg.recent_start, cfg.anchor)
    in_fallback = in_range(d, cfg.fallback_start, cfg.recent_start)
    in_month = in_range(d, cfg.anchor, cfg.next_anchor)
    fields = [
        F.sum(F.when(in_recent, q)).alias("recent_sum"),
        F.sum(F.when(in_fallback, q)).alias("fallback_sum"),
        F.sum(F.when(in_month, q)).alias("actual_sum"),
        F.count_if(in_recent).alias("recent_rows"),
        F.count_if(in_fallback).alias("fallback_rows"),
        F.count_if(in_month).alias("actual_rows"),
    ]
    if with_totals:
        fields += [F.sum(q).alias("total_qty"), F.sum("gross").alias("total_gross"),
                   F.sum("net").alias("total_net")]
        if "row_ord" in orders.columns:
            fields.append(F.min("row_ord").alias("name_ord"))
    return (o.withColumnRenamed("stock_code", "virtual_site")
            .groupBy(*_keys(orders), "sku", "virtual_site", "product_name")
            .agg(F.struct(*fields).alias("m")))


def _lines_of_months(sums: DataFrame, cfg: ModelConfig, with_totals: bool) -> DataFrame:
    """``sales_lines`` from sums per (purchase_month, sku, stock_code, product_name)."""
    month, qty, rows = F.col("purchase_month"), F.col("month_qty"), F.col("month_rows")
    o = sums.filter(~F.col("excluded_prefix_p"))
    if not with_totals:
        o = o.filter(in_months(month, cfg.fallback_start, cfg.next_anchor))
    windows = {"recent": in_months(month, cfg.recent_start, cfg.anchor),
               "fallback": in_months(month, cfg.fallback_start, cfg.recent_start),
               "actual": in_months(month, cfg.anchor, cfg.next_anchor)}
    fields = [F.sum(F.when(w, qty)).alias(f"{name}_sum") for name, w in windows.items()]
    fields += [F.coalesce(F.sum(F.when(w, rows)), F.lit(0)).alias(f"{name}_rows") for name, w in windows.items()]
    if with_totals:
        fields += [F.sum(qty).alias("total_qty"), F.sum("month_gross").alias("total_gross"),
                   F.sum("month_net").alias("total_net")]
        if "row_ord" in sums.columns:
            fields.append(F.min("row_ord").alias("name_ord"))
    return (o.withColumnRenamed("stock_code", "virtual_site")
            .groupBy(*_keys(sums), "sku", "virtual_site", "product_name")
            .agg(F.struct(*fields).alias("m")))


def site_sales_from_lines(lines: DataFrame) -> DataFrame:
    """E5 + E6 + E7 per (sku, virtual_site): window sums as double, row counts."""
    out = lines.groupBy(*_keys(lines), "sku", "virtual_site").agg(
        F.sum("m.recent_sum").alias("recent_sum"),
        F.sum("m.fallback_sum").alias("fallback_sum"),
        F.sum("m.actual_sum").alias("actual_sum"),
        F.sum("m.recent_rows").alias("recent_rows"),
        F.sum("m.fallback_rows").alias("fallback_rows"),
        F.sum("m.actual_rows").alias("actual_rows"))
    return (out
            .withColumn("recent_qty", F.coalesce(F.col("recent_sum").cast("double"), F.lit(0.0)))
            .withColumn("fallback_qty", F.coalesce(F.col("fallback_sum").cast("double"), F.lit(0.0)))
            .withColumn("actual_qty_jan", F.coalesce(F.col("actual_sum").cast("double"), F.lit(0.0)))
            .drop("recent_sum", "fallback_sum", "actual_sum"))


def site_sales(orders: DataFrame, cfg: ModelConfig, with_totals: bool = False) -> DataFrame:
    return site_sales_from_lines(sales_lines(orders, cfg, with_totals))


def window_sales(orders: DataFrame, cfg: ModelConfig) -> DataFrame:
    """C8 + E5-E7 as one table: pairs with any row in a window or in the month."""
    s = site_sales(orders, cfg, with_totals=False)
    return (s.filter((F.col("recent_rows") + F.col("fallback_rows") + F.col("actual_rows")) > 0)
            .select(*_keys(orders), "sku", "virtual_site", "recent_qty", "fallback_qty",
                    "actual_qty_jan"))


def baseline_columns(cfg: ModelConfig):
    """B22 + B26 + B21: the ordered recent / fallback / none choice, 9 columns."""
    use_recent = F.col("recent_qty") > 0
    use_fallback = ~use_recent & (F.col("fallback_qty") > 0)

    def pick(recent, fallback, default):
        return F.when(use_recent, recent).when(use_fallback, fallback).otherwise(default)

    qty = pick(F.col("recent_qty"), F.col("fallback_qty"), F.lit(0.0))
    days = pick(F.lit(cfg.recent_days), F.lit(cfg.fallback_days), F.lit(0)).cast("int")
    return {
        "baseline_method": F.lit(cfg.method_label),
        "baseline_source": pick(F.lit(cfg.recent_label), F.lit(cfg.fallback_label),
                                F.lit("no_history")),
        "baseline_window_start": pick(F.lit(cfg.recent_start.isoformat()),
                                      F.lit(cfg.fallback_start.isoformat()), F.lit("")),
        "baseline_window_end": pick(F.lit(cfg.recent_end.isoformat()),
                                    F.lit(cfg.fallback_end.isoformat()), F.lit("")),
        "baseline_window_days": days,
        "baseline_qty_window": qty,
        "baseline_daily_qty": safe_div(qty, days),
    }


BASELINE_COLUMNS = ["sku", "virtual_site", "baseline_method", "baseline_source",
                    "baseline_window_start", "baseline_window_end", "baseline_window_days",
                    "baseline_qty_window", "baseline_daily_qty", "recent_qty", "fallback_qty"]


def baseline(orders: DataFrame, cfg: ModelConfig) -> DataFrame:
    """Baseline per (sku, site) for pairs with at least one row in either window."""
    s = site_sales(orders, cfg, with_totals=False)
    s = s.filter((F.col("recent_rows") + F.col("fallback_rows")) > 0)
    return s.withColumns(baseline_columns(cfg)).select(*_keys(orders), *BASELINE_COLUMNS)


def unit_price_from_lines(lines: DataFrame) -> DataFrame:
    """Σgross/Σqty, Σnet/Σqty per sku over all orders (0 if Σqty <= 0) and the
    first product name (lowest file position when known, else the smallest)."""
    keys = _keys(lines)
    name = F.col("product_name")
    has_ord = "name_ord" in lines.schema["m"].dataType.fieldNames()
    name_key = F.when(name.isNotNull(), F.col("m.name_ord") if has_ord else name)
    agg = lines.groupBy(*keys, "sku").agg(
        F.sum("m.total_qty").alias("tq"), F.sum("m.total_gross").alias("tg"),
        F.sum("m.total_net").alias("tn"), F.min_by(name, name_key).alias("product_name"))
    tq, tg, tn = (F.col(c).cast("double") for c in ("tq", "tg", "tn"))
    return agg.select(*keys, "sku", "product_name",
                      safe_div(tg, tq).alias("gross_per_unit"),
                      safe_div(tn, tq).alias("net_per_unit"))


def unit_price(orders: DataFrame, cfg: ModelConfig) -> DataFrame:
    return unit_price_from_lines(sales_lines(orders, cfg, with_totals=True))
