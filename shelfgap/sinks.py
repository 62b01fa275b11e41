"""Result sinks and read-back checks.

Datasets are Parquet folders partitioned by ``channel`` and ``period``, in a folder
of their run.  Writes happen on the executors; nothing is collected.  Ordered CSV exports for people are optional
(a global sort is a range shuffle, so it is only paid when asked for).
"""

from __future__ import annotations

from itertools import accumulate

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .profiles import ChannelProfile, export_code
from .session import scratch_path
from .sources.readers import QUOTING, list_folder

# --- fixed values: report sheet names and output naming -------------------
SHEETS = {
    "summary_total": "Summary Total",
    "summary_site": "Summary by Site",
    "summary_sku": "Summary by SKU",
    "detail": "Detail SKU Site",
    "qa_summary": "QA Summary",
    "unmapped_sites": "QA Unmapped SiteCode",
    "calculation_example": "Calculation Example",
}
OUTPUT_NAME = "OOS_Opportunity_Lost_{code}_{period}_V5"
# ---------------------------------------------------------------------------

# H1-H4: the order each dataset is shown in, as (column, descending) pairs
SORT_KEYS = {
    "detail": [("lost_value_net_raw", True), ("sku", False), ("virtual_site", False)],
    "summary_site": [("lost_value_net_raw", True), ("virtual_site", False)],
    "summary_sku": [("lost_value_net_raw", True), ("sku", False)],
    "unmapped_sites": [("rows", True), ("site_code", False)],
    "qa_summary": [("seq", False)],
    "calculation_example": [("seq", False)],
    "summary_total": [("metric", False)],
}


# K3 "Definitions": what each detail column means, kept as column comments in
# the written schema instead of a separate sheet.
DETAIL_COMMENTS = {
    "virtual_site": "virtual site from the site map",
    "observed_days_jan": "calendar days of the evaluation month",
    "recorded_days": "days with any mapped stock row for the sku and site",
    "in_stock_days": "days whose summed stock balance is above zero",
    "oos_days_jan": "month days minus in-stock days (a day without a row counts as out of stock)",
    "oos_ratio_jan": "oos_days_jan / observed_days_jan",
    "baseline_source": "window that gave the baseline: recent, previous (fallback) or none",
    "baseline_window_start": "first day of the chosen baseline window",
    "baseline_window_end": "last day of the chosen baseline window",
    "baseline_window_days": "calendar days in the chosen baseline window",
    "recent_qty": "quantity sold in the recent window",
    "fallback_qty": "quantity sold in the fallback window",
    "baseline_qty_window": "quantity of the chosen window",
    "baseline_daily_qty": "baseline_qty_window / baseline_window_days",
    "expected_qty_jan": "baseline_daily_qty x observed_days_jan",
    "actual_qty_jan": "quantity sold in the evaluation month",
    "is_actual_zero_jan": "true when the month's quantity is zero or less; only then loss is kept",
    "qty_gap_jan": "expected minus actual quantity, not below zero",
    "lost_qty_raw": "baseline_daily_qty x oos_days_jan, zero when the sku sold in the month",
    "gross_per_unit": "all-time gross / quantity of the sku",
    "net_per_unit": "all-time net / quantity of the sku",
    "lost_value_gross_raw": "lost_qty_raw x gross_per_unit",
    "lost_value_net_raw": "lost_qty_raw x net_per_unit",
    "lost_qty": "same as lost_qty_raw",
    "loss_gross": "same as lost_value_gross_raw",
    "loss_net": "same as lost_value_net_raw",
}


def with_comments(df: DataFrame, comments: dict[str, str]) -> DataFrame:
    """Attach column comments as schema metadata (kept by Parquet)."""
    for name, text in comments.items():
        if name in df.columns:
            df = df.withMetadata(name, {"comment": text})
    return df


def output_name(profile: ChannelProfile, period: str) -> str:
    """K6: output base name of one run."""
    return OUTPUT_NAME.format(code=export_code(profile), period=period)


def observed_rows(df: DataFrame) -> tuple[Observation, DataFrame]:
    """The frame with an observation of its row count, known once it has been written."""
    seen = Observation()
    return seen, df.observe(seen, F.count(F.lit(1)).alias("rows"))


def observed(seen: Observation, name: str):
    """What was observed; None where the optimiser found that no row comes by, so nothing was."""
    try:
        return seen.get[name]
    except Py4JJavaError:
        return None


def partition_path(path: str, channel: str, period: str) -> str:
    return f"{path.rstrip('/')}/channel={channel}/period={period}"


def write_partitioned(df: DataFrame, path: str, channel: str, period: str) -> str:
    """K1/K2: write one dataset as exactly its channel=/period= partition.

    The partition's folder is overwritten as a whole, so a rerun with an empty
    result leaves no earlier rows, and other runs' partitions are not touched.
    No session setting is involved.
    """
    keys = [c for c in ("channel", "period") if c in df.columns]
    df.drop(*keys).write.mode("overwrite").parquet(partition_path(path, channel, period))
    return path


def is_complete(spark: SparkSession, folder: str) -> bool:
    """Whether a write to the folder has ended well: an empty result is complete, a missing one is not."""
    return "_SUCCESS" in (list_folder(spark, folder) or [])


def written_schema(df: DataFrame) -> T.StructType:
    """Schema of a dataset as written: its columns plus the partition columns."""
    fields = [f for f in df.schema.fields if f.name not in ("channel", "period")]
    return T.StructType(fields + [T.StructField("channel", T.StringType()),
                                  T.StructField("period", T.StringType())])


def read_partition(spark: SparkSession, path: str, channel: str, period: str,
                   schema: T.StructType | None = None) -> DataFrame:
    """Read one run's partition back.

    With the schema given, an empty dataset (no data files) reads as empty
    instead of failing schema inference."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(T.StructType([f for f in schema.fields if f.name not in ("channel", "period")]))
    return (reader.parquet(partition_path(path, channel, period))
            .withColumns({"channel": F.lit(channel), "period": F.lit(period)}))


def sort_columns(dataset: str) -> list[Column]:
    return [F.desc(c) if desc else F.asc(c) for c, desc in SORT_KEYS.get(dataset, [])]


ROW_BITS = 33       # of monotonically_increasing_id: the row in its partition; above it the partition


def with_place(df: DataFrame, dataset: str) -> DataFrame:
    """``place``: where each row stands in the dataset's order (H1-H4), from 1.

    The rows are dealt out by ranges of the order, sorted inside their
    partitions and landed with their place there, so that what follows sees the
    same ranges.  The rows of the partitions before are then added: one number
    a partition, summed at the driver.  No row passes through a single task.
    """
    spark, keys = df.sparkSession, sort_columns(dataset)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    path = scratch_path(spark, f"place-{dataset}")
    (df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
     .withColumn("_at", F.monotonically_increasing_id()).write.parquet(path))
    landed = spark.read.parquet(path).withColumn("_part", F.shiftright("_at", ROW_BITS))
    counts = sorted((r["_part"], r["count"]) for r in landed.groupBy("_part").count().collect())
    ends = accumulate(n for _, n in counts)
    offsets = spark.createDataFrame([(part, end - n) for (part, n), end in zip(counts, ends)], "_part long, _before long")
    local = F.col("_at").bitwiseAND((1 << ROW_BITS) - 1)
    return (landed.join(F.broadcast(offsets), "_part")      # a row per partition
            .select(*df.columns, (local + F.col("_before") + 1).alias("place")))


def export_csv(df: DataFrame, path: str, dataset: str) -> str:
    """Ordered CSV with a header for people (H1-H4 order)."""
    keys = sort_columns(dataset)
    out = df.orderBy(*keys) if keys else df
    out.write.mode("overwrite").option("header", True).options(**QUOTING).csv(path)
    return path


def verify_written(spark: SparkSession, counts: dict[str, int], paths: dict[str, str], channel: str,
                   period: str, schemas: dict[str, T.StructType]) -> None:
    """K7: every dataset's partition of this run is complete, opens and holds the rows that were written.

    Uses the same filesystem layer as the writes, so it works for any shared store.
    """
    wrong = []
    for name, want in counts.items():
        if not is_complete(spark, partition_path(paths[name], channel, period)):
            wrong.append(f"{name} was not written to its end")
            continue
        try:
            have = read_partition(spark, paths[name], channel, period, schemas[name]).count()
        except AnalysisException as e:
            wrong.append(f"{name} cannot be opened ({e.getCondition()})")
            continue
        if have != want:
            wrong.append(f"{name} holds {have} of {want} rows")
    if wrong:
        raise ValueError("datasets of this run are incomplete: " + "; ".join(wrong))
