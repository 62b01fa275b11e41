"""Site-map status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def site_map_status(site_map: DataFrame, sample: int = 5) -> DataFrame:
    """One row: active mapping rows, distinct site codes, distinct virtual sites
    and the first ``sample`` virtual sites in sorted order.

    The sample is a bounded top-k (TakeOrderedAndProject) read as a scalar
    subquery, so no unbounded set is ever gathered into one row.
    """
    first = (site_map.select("virtual_site").distinct().orderBy("virtual_site").limit(sample)
             .agg(F.array_join(F.sort_array(F.collect_list("virtual_site")), ",")))
    counts = site_map.agg(
        F.count(F.lit(1)).alias("active_mapping_rows"),
        F.countDistinct("site_code").alias("site_count"),
        F.countDistinct("virtual_site").alias("virtual_site_count"))
    return counts.select(
        (F.col("active_mapping_rows") > 0).alias("is_ready"),
        "active_mapping_rows", "site_count", "virtual_site_count",
        F.coalesce(first.scalar(), F.lit("")).alias("sample_virtual_sites"))
