"""The loss model: universe, SKU x site grid and the 29-column detail
(SURVEY C5, C6, D2, D6-D9, D12, F4, I1, I3, B24-B30).

One plan for any number of sites and channels:
  orders  -> left semi with the universe -> sums per (channel, sku, site, name)
          -> prices per (channel, sku), window sums per (channel, sku, site)
  stock   -> sums per (channel, day, sku, site) -> day counts per (channel, sku, site)
  grid    =  universe exploded over the site list, joined with these on their full keys
Everything that is joined is aggregated; the grid has the size of the result.
The site list reaches the plan as a scalar subquery, so it is neither read by
the driver nor crossed.  Inputs that carry no ``channel`` column hold for every
channel of the site map; those that do are keyed by it throughout.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import clip0
from ..profiles import ModelConfig
from . import sales as S
from . import stock as K


@dataclass
class ModelInputs:
    product: DataFrame
    orders: DataFrame
    stock: DataFrame
    site_map: DataFrame     # channel, site_code, virtual_site


# --- fixed values: the columns of the detail, in order -----------------------
DETAIL_COLUMNS = [
    "sku", "product_name", "virtual_site", "observed_days_jan", "recorded_days",
    "in_stock_days", "oos_days_jan", "oos_ratio_jan", "baseline_method", "baseline_source",
    "baseline_window_start", "baseline_window_end", "baseline_window_days", "recent_qty",
    "fallback_qty", "baseline_qty_window", "baseline_daily_qty", "expected_qty_jan",
    "actual_qty_jan", "is_actual_zero_jan", "qty_gap_jan", "lost_qty_raw", "gross_per_unit",
    "net_per_unit", "lost_value_gross_raw", "lost_value_net_raw", "lost_qty", "loss_gross",
    "loss_net",
]
# ---------------------------------------------------------------------------


def universe(product: DataFrame, cfg: ModelConfig) -> DataFrame:
    """I1 = C5 + C6 + F4: eligible ([channel,] sku, product_name).

    C6: live SKUs only, unless none is live -- then all; per channel where the
    products carry one.  Whether any is live comes from a small aggregate
    inside the plan (no count action, no cross join).
    """
    p = product.filter(~F.col("excluded_prefix_p"))
    keys = K.shared_keys(product, "sku", "product_name")
    if cfg.use_live_skus_only and "status" in product.columns:
        is_live = F.coalesce(F.lower(F.col("status").cast("string")) == "live", F.lit(False))
        if "channel" in product.columns:
            any_live = p.groupBy("channel").agg(F.max(is_live).alias("any_live"))
            p = p.join(any_live, "channel").filter(is_live | ~F.col("any_live"))
        else:
            any_live = p.select(F.max(is_live)).scalar()
            p = p.filter(is_live | ~F.coalesce(any_live, F.lit(False)))
    return p.select(*keys).dropDuplicates(keys)


def site_names(site_map: DataFrame, channel: str | None = None) -> list[str]:
    """Sorted virtual sites of a channel (or all): the pivot's column names, so a schema, not data.

    As with Spark's own pivot, more names than ``spark.sql.pivotMaxValues`` are an error.
    """
    rows = site_map if channel is None else site_map.filter(F.col("channel") == channel)
    most = int(site_map.sparkSession.conf.get("spark.sql.pivotMaxValues", "10000"))
    names = [r[0] for r in rows.select("virtual_site").distinct().limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"the pivot by virtual site would have more than {most} columns")
    return sorted(names)


def site_grid(skus: DataFrame, site_map: DataFrame) -> DataFrame:
    """Every SKU row once per (channel, virtual_site), its own channel's if it has one."""
    if "channel" in skus.columns:
        # a map from channel to its sites: no SKU is put under the sites of other channels
        own = site_map.groupBy("channel").agg(F.sort_array(F.collect_set("virtual_site")).alias("sites"))
        sites = own.select(F.map_from_entries(F.collect_list(F.struct("channel", "sites")))).scalar()
        rows = skus.withColumn("virtual_site", F.explode(F.try_element_at(sites, F.col("channel"))))
        return rows.select(*[c for c in skus.columns if c != "channel"], "channel", "virtual_site")
    site = F.struct("channel", "virtual_site")
    sites = site_map.select(F.sort_array(F.collect_set(site))).scalar()
    return skus.withColumn("_site", F.explode(sites)).select(*skus.columns, "_site.channel", "_site.virtual_site")


def _with_day_counts(grid: DataFrame, inputs: ModelInputs, cfg: ModelConfig,
                     day_bal: DataFrame | None = None) -> DataFrame:
    if day_bal is None:
        day_bal = K.day_balance(inputs.stock, inputs.site_map, cfg)
    counts = K.stock_day_counts(day_bal)
    return grid.join(counts, ["channel", "sku", "virtual_site"], "left")


def oos_days(inputs: ModelInputs, cfg: ModelConfig) -> DataFrame:
    """Grid of universe SKUs x sites with recorded / in-stock / OOS days and ratio."""
    uni = universe(inputs.product, cfg)
    skus = uni.select(*K.shared_keys(uni, "sku")).distinct()
    joined = _with_day_counts(site_grid(skus, inputs.site_map), inputs, cfg)
    return K.with_oos_measures(joined, cfg).select(
        "channel", "sku", "virtual_site", "observed_days_jan", "recorded_days", "in_stock_days",
        "oos_days_jan", "oos_ratio_jan")


def loss_detail(inputs: ModelInputs, cfg: ModelConfig, day_bal: DataFrame | None = None) -> DataFrame:
    """The detail table -- 29 columns plus ``channel``.

    ``day_bal`` is the month's day balance if it has been landed already.
    Sorting (H1) is left to the sinks; the frame itself is unordered.
    """
    uni = universe(inputs.product, cfg)
    # Only orders of universe SKUs are aggregated
    own = [k for k in K.shared_keys(inputs.orders, "sku") if k in uni.columns]
    orders = inputs.orders.join(uni.select(*own).distinct(), own, "left_semi")
    lines = S.sales_lines(orders, cfg, with_totals=True)
    price = S.unit_price_from_lines(lines).withColumnRenamed("product_name", "order_name")
    site = S.site_sales_from_lines(lines).select(
        *K.shared_keys(lines, "sku", "virtual_site"), "recent_qty", "fallback_qty", "actual_qty_jan")
    d = _with_day_counts(site_grid(uni, inputs.site_map), inputs, cfg, day_bal)
    d = (d.join(site, K.shared_keys(site, "sku", "virtual_site"), "left")
         .join(price, K.shared_keys(price, "sku"), "left")
         .withColumns({"product_name": F.coalesce("product_name", "order_name"),
                       "gross_per_unit": F.coalesce("gross_per_unit", F.lit(0.0)),
                       "net_per_unit": F.coalesce("net_per_unit", F.lit(0.0))}))
    d = K.with_oos_measures(d, cfg)
    # No sales rows -> zero quantities and the "no history" labels
    d = d.withColumns({c: F.coalesce(F.col(c), F.lit(0.0))
                       for c in ("recent_qty", "fallback_qty", "actual_qty_jan")})
    d = d.withColumns(S.baseline_columns(cfg))
    # measures
    days = F.lit(cfg.eval_days)
    lost = F.col("baseline_daily_qty") * F.col("oos_days_jan")
    is_zero = F.col("actual_qty_jan") <= 0.0
    if cfg.loss_only_when_actual_zero:
        lost = F.when(is_zero, lost).otherwise(F.lit(0.0))
    d = d.withColumns({
        "expected_qty_jan": F.col("baseline_daily_qty") * days,
        "is_actual_zero_jan": is_zero,
        "lost_qty_raw": lost,
    })
    d = d.withColumns({
        "qty_gap_jan": clip0(F.col("expected_qty_jan") - F.col("actual_qty_jan")).cast("double"),
        "lost_value_gross_raw": F.col("lost_qty_raw") * F.col("gross_per_unit"),
        "lost_value_net_raw": F.col("lost_qty_raw") * F.col("net_per_unit"),
    })
    d = d.withColumns({
        "lost_qty": F.col("lost_qty_raw"),
        "loss_gross": F.col("lost_value_gross_raw"),
        "loss_net": F.col("lost_value_net_raw"),
    })
    return d.select("channel", *DETAIL_COLUMNS)
