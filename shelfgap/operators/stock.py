"""Stock side of the model: month filter, site mapping, daily balance, OOS days
and unmapped sites (SURVEY C7, C9, C10, D1-D4, E1-E3, E9, I2).

Plan shape: the month filter is a half-open range so it reaches the Parquet
scan; the site map join fans a site out to every virtual site it maps to
(reference semantics; whether the map is broadcast is left to Spark's byte
threshold and AQE); E1 sums per (channel, day, sku, virtual site) with a
map-side partial aggregate, so a hot sku/site is combined before the shuffle;
E2/E3 then see at most one row per day per (sku, site) -- 31 rows -- and are
computed in one pass with ``count_if``/``count`` instead of two distinct counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import clip0, safe_div
from ..functions.dates import in_range
from ..profiles import ModelConfig


def shared_keys(df: DataFrame, *keys: str) -> list[str]:
    """``keys`` led by ``channel`` if the frame carries one (else it holds for every channel)."""
    return (["channel"] if "channel" in df.columns else []) + list(keys)


def eval_month_stock(stock: DataFrame, cfg: ModelConfig) -> DataFrame:
    """C7 + C5: stock rows of the evaluation month without excluded SKUs.

    With a month-partitioned store (``posting_month``) the same month is also
    required of the partition column, so only that month's files are listed
    and read (partition pruning); the date range still decides row by row.
    """
    cond = in_range(F.col("posting_date"), cfg.anchor, cfg.next_anchor) & ~F.col("excluded_prefix_p")
    if "posting_month" in stock.columns:
        cond = cond & (F.col("posting_month") == F.lit(cfg.period))
    return stock.filter(cond)


def day_balance(stock: DataFrame, site_map: DataFrame, cfg: ModelConfig) -> DataFrame:
    """D1 + E1: Σ stock_balance per (channel, posting_date, sku, virtual_site)."""
    on = shared_keys(stock, "site_code")
    s = eval_month_stock(stock, cfg).select(*on, "posting_date", "sku", "stock_balance")
    mapped = s.join(site_map.select("channel", "site_code", "virtual_site"), on)
    return (mapped.groupBy("channel", "posting_date", "sku", "virtual_site")
            .agg(F.sum("stock_balance").alias("stock_balance")))


def stock_day_counts(day_bal: DataFrame) -> DataFrame:
    """E2 + E3: in-stock days (Σ balance > 0) and recorded days per (channel, sku, site).

    Rows of ``day_bal`` are unique per day, so plain counts equal the
    reference's distinct-date counts.
    """
    return (day_bal.groupBy("channel", "sku", "virtual_site")
            .agg(F.count_if(F.col("stock_balance") > 0).cast("int").alias("in_stock_days"),
                 F.count(F.lit(1)).cast("int").alias("recorded_days")))


def with_oos_measures(df: DataFrame, cfg: ModelConfig) -> DataFrame:
    """D3/D4 fills + B23 + B21 on a grid already left-joined with the day counts."""
    days = F.lit(cfg.eval_days)
    in_stock = F.coalesce(F.col("in_stock_days"), F.lit(0))
    oos = clip0(days - in_stock).cast("int")
    return df.withColumns({
        "in_stock_days": in_stock,
        "recorded_days": F.coalesce(F.col("recorded_days"), F.lit(0)),
        "observed_days_jan": days.cast("int"),
        "oos_days_jan": oos,
        "oos_ratio_jan": safe_div(oos.cast("double"), days.cast("double")),
    })


def unmapped_sites(stock: DataFrame, site_map: DataFrame, cfg: ModelConfig,
                   per_channel: bool = False) -> DataFrame:
    """C10 + E9: month stock rows whose site code is in no mapping, counted per code.

    With ``per_channel`` (or stock that carries a channel) the codes are judged
    per channel: one mapped in one channel may be unmapped in another.  Stock
    without a channel then counts for every channel of the site map; the counts
    are taken before the rows are fanned out to channels.

    Order (rows desc, H4) is applied by the sinks, not here.
    """
    own = "channel" in stock.columns
    on = shared_keys(stock, "site_code") if own or not per_channel else ["channel", "site_code"]
    counts = (eval_month_stock(stock, cfg).groupBy(*shared_keys(stock, "site_code"))
              .agg(F.count(F.lit(1)).alias("rows")))
    if per_channel and not own:
        channels = site_map.select(F.sort_array(F.collect_set("channel"))).scalar()
        counts = counts.withColumn("channel", F.explode(channels))
    known = site_map.select(*on).distinct()
    return counts.join(known, on, "left_anti").select(*on, "rows")
