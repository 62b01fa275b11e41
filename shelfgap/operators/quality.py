"""QA metrics, input profiling/validation, month suggestion, overview, content
fingerprints and run records (SURVEY A15, E14, E16, E17, E19, E21, E22, I4,
I5, I10, I11, I13).

Every result is a small DataFrame computed by aggregates over the inputs or
the result tables.  Single-row combinations use scalar subqueries or unions
of unpivoted aggregates -- never a cross join and never a driver loop over
data.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import month_bucket, with_best_timestamp, with_month_first_timestamp
from ..profiles import NEAR_EMPTY_ROW_COUNT, ChannelProfile, ModelConfig, get_profile
from ..sources.contracts import SLOT_LABELS, SLOTS, contract_for, missing_columns
from ..functions.cleaning import active_flag, normalize_virtual_site, unread_number
from . import model as M
from . import stock as K
from .reports import TOTAL_METRICS, exact_sum

# --- fixed values: finding codes and messages ------------------------------
MSG_UNKNOWN_SLOT = "Validation does not support upload slot '{slot}'."
MSG_REQUIRED = "{label}: upload required."
MSG_MISSING_COLUMNS = "Missing required columns: {cols}"
MSG_NO_ACTIVE = "The site-mapping file does not contain any active rows marked with 'X'."
MSG_NO_CHANNEL = ("The site-mapping file does not contain any active {label} virtual locations. "
                  "Check that the uploaded workbook matches the selected channel.")
MSG_EMPTY = "The file parsed successfully but contains no data rows."
MSG_NEAR_EMPTY = "The file parsed successfully but contains very few rows."
MSG_MULTI_MONTH = "Detected data from multiple months in the uploaded file."
REASON_ONE_MONTH = "Detected one calendar month in the staged stock file."
REASON_NO_DATES = "The staged stock file did not contain any parseable posting dates."
REASON_MANY_MONTHS = ("The staged stock file spans multiple months. "
                      "Choose the evaluation month manually.")
# ---------------------------------------------------------------------------
MSG_UNPARSED = "%d value(s) of {field} are no date in any accepted layout."
MSG_REJECTED = "%d line(s) were set aside: %s."
MSG_NUMBERS = "%d value(s) of {field} are no number, or hold more digits than are kept."

FINDING_SCHEMA = T.StructType([
    T.StructField("dataset", T.StringType(), False),
    T.StructField("severity", T.StringType(), False),
    T.StructField("code", T.StringType(), False),
    T.StructField("message", T.StringType(), False),
])


def _spark(df: DataFrame) -> SparkSession:
    return df.sparkSession


def _long(df: DataFrame, metrics: list[tuple[int, str, Column]]) -> DataFrame:
    """One aggregate pass over ``df`` -> (seq, metric, value) rows."""
    wide = df.agg(*[v.cast("double").alias(f"m{seq}") for seq, _, v in metrics])
    arr = F.array(*[F.struct(F.lit(seq).alias("seq"), F.lit(name).alias("metric"),
                             F.col(f"m{seq}").alias("value")) for seq, name, _ in metrics])
    return wide.select(F.explode(arr).alias("r")).select("r.seq", "r.metric", "r.value")


def qa_summary(inputs: M.ModelInputs, cfg: ModelConfig, detail: DataFrame | None = None,
               unmapped: DataFrame | None = None, day_bal: DataFrame | None = None,
               excluded_orders: float | None = None, excluded_stock: float | None = None) -> DataFrame:
    """The 20 QA metrics as (seq, metric, value); seq keeps the reference order.

    What has been counted in passing is given and not counted again.
    """
    if detail is None:
        detail = M.loss_detail(inputs, cfg)
    if unmapped is None:
        unmapped = K.unmapped_sites(inputs.stock, inputs.site_map, cfg)
    uni = M.universe(inputs.product, cfg)
    if day_bal is None:
        day_bal = K.day_balance(inputs.stock, inputs.site_map, cfg)
    excl = F.col("excluded_prefix_p")
    src = F.col("baseline_source")
    zero = F.col("is_actual_zero_jan")
    parts = [
        _long(inputs.product, [
            (1, "product_sku_count_all", F.countDistinct("sku")),
            (2, "product_sku_count_excl_prefix_p", F.countDistinct(F.when(~excl, F.col("sku")))),
            (18, "excluded_prefix_p_products", F.count_if(excl))]),
        _long(uni, [
            (3, "product_sku_count_live_excl_prefix_p", F.countDistinct("sku")),
            (4, "sku_universe_count", F.countDistinct("sku"))]),
        _long(day_bal, [(5, "daily_stock_rows_eval_month", F.count(F.lit(1)))]),
        _long(inputs.site_map, [(6, "mapped_site_codes_count", F.countDistinct("site_code"))]),
        _long(unmapped, [(7, "unmapped_site_code_count", F.count(F.lit(1)))]),
        _long(detail, [
            (8, "detail_rows", F.count(F.lit(1))),
            (9, "config_baseline_recent_months", F.lit(cfg.baseline_recent_months)),
            (10, "config_baseline_fallback_months", F.lit(cfg.baseline_fallback_months)),
            (11, "detail_rows_baseline_recent", F.count_if(src == cfg.recent_label)),
            (12, "detail_rows_baseline_fallback", F.count_if(src == cfg.fallback_label)),
            (13, "detail_rows_baseline_no_history", F.count_if(src == "no_history")),
            (14, "detail_rows_actual_zero", F.count_if(zero)),
            (15, "detail_rows_actual_gt_zero", F.count_if(~zero)),
            (16, "config_loss_only_when_actual_zero", F.lit(int(cfg.loss_only_when_actual_zero))),
            (17, "total_lost_value_net_raw",
             F.coalesce(exact_sum("lost_value_net_raw"), F.lit(0.0)))]),
    ]
    known = [(19, "excluded_prefix_p_orders", inputs.orders, excluded_orders),
             (20, "excluded_prefix_p_daily_stock", inputs.stock, excluded_stock)]
    for seq, name, table, value in known:
        if value is not None:
            parts.append(table.sparkSession.createDataFrame([(seq, name, value)], "seq int, metric string, value double"))
        else:
            rows = F.col("month_rows") if "month_rows" in table.columns else F.lit(1)
            parts.append(_long(table, [(seq, name, F.coalesce(F.sum(F.when(excl, rows)), F.lit(0)))]))
    return reduce(DataFrame.unionByName, parts)


# ------------------------------------------------------------ profiling --
def _with_day(slot: str, raw: DataFrame, field: str) -> DataFrame:
    """``raw`` with the day that the loaders read from its date field, as ``_day``."""
    read = with_best_timestamp if slot == "sales" else with_month_first_timestamp
    return read(raw, field, "_day").withColumn("_day", F.to_date("_day"))


def input_profile(slot: str, raw: DataFrame, channel: str) -> DataFrame:
    """Row count, date field, min/max date and month hints of one input."""
    field = contract_for(slot, channel).date_field
    if field is None or field not in raw.columns:
        return raw.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(slot).alias("dataset"), "row_count",
            F.lit(field).cast("string").alias("date_field"),
            F.lit(None).cast("date").alias("min_date"), F.lit(None).cast("date").alias("max_date"),
            F.lit("").alias("month_hints"))
    days = _with_day(slot, raw, field).select(F.col("_day").alias("d"))
    # one pass; the month set holds one entry per calendar month present
    months = F.array_join(F.sort_array(F.collect_set(month_bucket(F.col("d")))), ",")
    return days.agg(F.count(F.lit(1)).alias("row_count"), F.min("d").alias("min_date"),
                    F.max("d").alias("max_date"), months.alias("month_hints")).select(
        F.lit(slot).alias("dataset"), "row_count", F.lit(field).alias("date_field"),
        "min_date", "max_date", "month_hints")


def input_profiles(raw: dict[str, DataFrame], channel: str) -> DataFrame:
    return reduce(DataFrame.unionByName,
                  [input_profile(slot, df, channel) for slot, df in raw.items()])


# ------------------------------------------------------------ findings --
def _finding(dataset: str, severity: str, code: str, message: str | Column) -> Column:
    msg = message if isinstance(message, Column) else F.lit(message)
    return F.struct(F.lit(dataset).alias("dataset"), F.lit(severity).alias("severity"),
                    F.lit(code).alias("code"), msg.alias("message"))


def dataset_findings(slot: str, raw: DataFrame, channel: str, dataset: str | None = None,
                     site_profile: ChannelProfile | None = None) -> DataFrame:
    """I4 for one input: contract errors first; warnings only for valid inputs."""
    dataset = dataset or slot
    spark = _spark(raw)
    if slot not in SLOTS:
        return spark.createDataFrame([(dataset, "error", "unknown_slot", MSG_UNKNOWN_SLOT.format(slot=slot))],
                                     FINDING_SCHEMA)
    contract = contract_for(slot, channel)
    gaps = missing_columns(raw, contract.required_columns)
    if gaps:
        return spark.createDataFrame(
            [(dataset, "error", "missing_required_columns",
              MSG_MISSING_COLUMNS.format(cols=", ".join(gaps)))], FINDING_SCHEMA)
    if slot == "site_mapping":
        profile = site_profile or get_profile(channel)
        allowed = list(profile.sites)
        is_active = active_flag("Active") == "X"
        in_channel = (normalize_virtual_site("Virtual Location").isin(allowed) if allowed
                      else F.lit(True))
        stats = raw.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_active).alias("active"),
                        F.count_if(is_active & in_channel).alias("matched"))
        checks = F.array(
            F.when(F.col("active") == 0,
                   _finding(dataset, "error", "site_mapping_no_active_rows", MSG_NO_ACTIVE)),
            F.when((F.col("active") > 0) & (F.col("matched") == 0),
                   _finding(dataset, "error", "site_mapping_no_channel_rows",
                            MSG_NO_CHANNEL.format(label=profile.label))),
            F.when((F.col("matched") > 0) & (F.col("n") <= NEAR_EMPTY_ROW_COUNT),
                   _finding(dataset, "warning", "near_empty_dataset", MSG_NEAR_EMPTY)))
        return (stats.select(F.explode(checks).alias("f")).filter(F.col("f").isNotNull())
                .select("f.*"))
    field = contract.date_field
    odd = [unread_number(c, raw.schema[c].dataType, slot == "sales").alias(f"_n{i}")
           for i, c in enumerate(contract.number_fields) if c in raw.columns]
    if field:
        written = F.trim(F.col(f"`{field}`").cast("string")) != ""
        days = _with_day(slot, raw, field).select(F.col("_day").alias("d"), written.alias("written"), *odd)
    else:
        days = raw.select(F.lit(None).cast("date").alias("d"), F.lit(False).alias("written"))
    # one pass: rows, distinct months, date texts that no layout reads and numbers that are not kept
    stats = days.agg(F.count(F.lit(1)).alias("n"),
                     F.countDistinct(month_bucket(F.col("d"))).alias("months"),
                     F.count_if(F.col("written") & F.col("d").isNull()).alias("unparsed"),
                     *[F.count_if(f"_n{i}").alias(f"_n{i}") for i in range(len(odd))])
    numbers = [F.when(F.col(f"_n{i}") > 0, _finding(dataset, "warning", "unparsed_numbers", F.format_string(
        MSG_NUMBERS.format(field=c), F.col(f"_n{i}")))) for i, c in enumerate(contract.number_fields[:len(odd)])]
    checks = F.array(
        F.when(F.col("n") == 0, _finding(dataset, "warning", "empty_dataset", MSG_EMPTY)),
        F.when((F.col("n") > 0) & (F.col("n") <= NEAR_EMPTY_ROW_COUNT),
               _finding(dataset, "warning", "near_empty_dataset", MSG_NEAR_EMPTY)),
        F.when(F.col("months") > 1, _finding(dataset, "warning", "multiple_month_hints",
                                             MSG_MULTI_MONTH)),
        F.when(F.col("unparsed") > 0, _finding(dataset, "warning", "unparsed_dates", F.format_string(
            MSG_UNPARSED.format(field=field), F.col("unparsed")))), *numbers)
    return stats.select(F.explode(checks).alias("f")).filter(F.col("f").isNotNull()).select("f.*")


def input_findings(raw: dict[str, DataFrame], channel: str,
                   site_profile: ChannelProfile | None = None) -> DataFrame:
    """I4 over all inputs; the site map is checked against ``site_profile`` and,
    when that differs, also against the channel's own profile."""
    parts = [dataset_findings(slot, df, channel, site_profile=site_profile)
             for slot, df in raw.items()]
    own = get_profile(channel)
    if "site_mapping" in raw and site_profile is not None and site_profile.key != own.key:
        parts.append(dataset_findings("site_mapping", raw["site_mapping"], channel,
                                      dataset=f"site_mapping_{own.key}", site_profile=own))
    return reduce(DataFrame.unionByName, parts)


def rejected_findings(rejected: DataFrame, dataset: str) -> DataFrame:
    """I4: a finding per kind of rejected line (``readers.land_checked``), with their number."""
    counts = rejected.groupBy("_state").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.lit(dataset).alias("dataset"), F.lit("warning").alias("severity"),
                         F.concat(F.lit("rejected_lines_"), F.col("_state")).alias("code"),
                         F.format_string(MSG_REJECTED, F.col("n"), F.col("_state")).alias("message"))


def quality_gate(findings: DataFrame, supplied: list[str], required: Sequence[str] = ()) -> DataFrame:
    """Per dataset error/warning counts, readiness and blocking messages, plus an 'ALL' row.

    A required dataset that was not supplied blocks the run, as does any with errors.
    """
    spark = _spark(findings)
    names = sorted({*supplied, *required})
    labels = {d: SLOT_LABELS.get(d, d) for d in names}
    dims = spark.createDataFrame(
        [(d, labels[d], None if d in supplied else MSG_REQUIRED.format(label=labels[d])) for d in names],
        "dataset string, label string, absent string")
    is_error = F.col("severity") == "error"
    per = findings.groupBy("dataset").agg(
        F.count_if(is_error).alias("error_count"), F.count_if(F.col("severity") == "warning").alias("warning_count"),
        F.sort_array(F.collect_list(F.when(is_error, F.col("message")))).alias("errors"))
    none = F.expr("cast(array() as array<string>)")
    said = F.transform(F.coalesce("errors", none), lambda m: F.concat(F.col("label"), F.lit(": "), m))
    per = dims.join(per, "dataset", "left").select(
        "dataset", F.coalesce("error_count", F.lit(0)).cast("long").alias("error_count"),
        F.coalesce("warning_count", F.lit(0)).cast("long").alias("warning_count"),
        F.array_compact(F.concat(F.array("absent"), said)).alias("blocking"))
    per = per.withColumn("is_ready", F.size("blocking") == 0)
    total = per.agg(F.lit("ALL").alias("dataset"),
                    F.sum("error_count").cast("long").alias("error_count"),
                    F.sum("warning_count").cast("long").alias("warning_count"),
                    F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("dataset", "blocking"))),
                                          lambda x: x["blocking"])).alias("blocking"),
                    (F.count_if("is_ready") == F.count(F.lit(1))).alias("is_ready"))
    return per.unionByName(total).select("dataset", "error_count", "warning_count", "is_ready",
                                         F.array_join("blocking", "; ").alias("blocking_messages"))


# ------------------------------------------------------- month suggestion --
def month_suggestion(stock: DataFrame, date_col: str = "posting_date") -> DataFrame:
    """One calendar month in the stock dates -> confident suggestion."""
    months = (stock.filter(F.col(date_col).isNotNull())
              .select(month_bucket(F.col(date_col)).alias("m")).distinct())
    agg = months.agg(F.sort_array(F.collect_list("m")).alias("hints"))
    n = F.size("hints")
    first = F.element_at("hints", 1)
    return agg.select(
        F.when(n == 1, F.substring(first, 1, 4).cast("int")).alias("eval_year"),
        F.when(n == 1, F.substring(first, 6, 2).cast("int")).alias("eval_month"),
        (n == 1).alias("is_confident"),
        F.array_join("hints", ",").alias("month_hints"),
        F.when(n == 1, REASON_ONE_MONTH).when(n == 0, REASON_NO_DATES)
        .otherwise(REASON_MANY_MONTHS).alias("reason"))


# -------------------------------------------------------------- overview --
TOTAL_COLUMNS = ["total_lost_qty_raw", "total_lost_value_gross_raw", "total_lost_value_net_raw"]


def overview_totals(summary_total: DataFrame) -> DataFrame:
    """(metric, value) rows -> one row keyed by metric, missing -> 0."""
    return summary_total.agg(*[
        F.coalesce(F.max(F.when(F.col("metric") == label, F.col("value"))), F.lit(0.0)).alias(name)
        for (label, _), name in zip(TOTAL_METRICS, TOTAL_COLUMNS)])


def overview(detail: DataFrame, qa: DataFrame, unmapped: DataFrame, findings: DataFrame,
             period: str, is_current: bool = True,
             changes: DataFrame | None = None) -> DataFrame:
    """Overview numbers and the trust reasons, one row.

    ``changes`` (from ``changed_inputs``) decides "current" inside the plan:
    the run is current when no input fingerprint changed since it was stored.
    """
    # one pass over the detail: row count and the three totals (E10 / E21 values)
    head = detail.agg(F.count(F.lit(1)).alias("detail_row_count"),
                      *[F.coalesce(exact_sum(src), F.lit(0.0)).alias(name)
                        for (_, src), name in zip(TOTAL_METRICS, TOTAL_COLUMNS)])
    qa_rows = qa.select(F.count(F.lit(1))).scalar()
    unmapped_rows = unmapped.select(F.count(F.lit(1))).scalar()
    warnings = findings.select(F.count_if(F.col("severity") == "warning")).scalar()
    current = F.lit(is_current)
    if changes is not None:
        current = current & ~changes.filter(F.col("changed")).exists()
    reasons = F.array_compact(F.array(
        F.when(warnings > 0, F.format_string("%d upload warning(s)", warnings)),
        F.when(unmapped_rows > 0, F.format_string("%d unmapped site row(s)", unmapped_rows)),
        F.when(~current, F.lit("staged inputs changed after the last successful run"))))
    return head.select(
        F.lit(period).alias("period"), "detail_row_count",
        qa_rows.alias("qa_summary_row_count"), unmapped_rows.alias("unmapped_site_count"),
        F.col("total_lost_value_net_raw").alias("lost_value_net_raw"), *TOTAL_COLUMNS,
        warnings.alias("warning_count"), current.alias("is_current"),
        F.array_join(reasons, "; ").alias("trust_reasons"))


# ---------------------------------------------------------- fingerprints --
def fingerprint(df: DataFrame, dataset: str) -> DataFrame:
    """Order-independent content fingerprint of one table.

    A row's columns are written with their lengths and with a mark for null, so
    no two rows are written alike; the halves of the rows' md5 digests are
    summed.  Row order and partitioning do not matter; added, removed, changed
    or repeated rows do.
    """
    def written(c: str) -> Column:
        text = F.col(f"`{c}`").cast("string")
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    digest = F.md5(F.concat(*[written(c) for c in df.columns]).cast("binary"))
    halves = [F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20,0)") for at in (1, 16)]
    return df.select(*[h.alias(n) for h, n in zip(halves, "ab")]).agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.coalesce(F.sum(n), F.lit(0)).cast("string").alias(f"hash_{n}") for n in "ab"]).select(
            F.lit(dataset).alias("dataset"), "*")


def fingerprints(raw: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [fingerprint(df, name) for name, df in raw.items()])


def changed_inputs(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Which inputs differ from the stored fingerprints (new, changed or gone)."""
    facts = ("row_count", "hash_a", "hash_b")
    before = stored.select("dataset", F.struct(*facts).alias("before"))
    now = current.select("dataset", F.struct(*facts).alias("now"))
    return now.join(before, "dataset", "full").select("dataset", (~F.col("now").eqNullSafe(F.col("before")))
                                                      .alias("changed"))


# ------------------------------------------------------------ run record --
RECORD_COLUMNS = ("channel string, period string, ok boolean, status string, detail_row_count long, "
                  "qa_summary_row_count long, unmapped_site_count long, lost_value_net_raw double, "
                  "error_type string, error_message string")


def run_record(detail: DataFrame, qa: DataFrame, unmapped: DataFrame, channel: str, period: str) -> DataFrame:
    """I13 + E19: the row of a run that succeeded, for a run-log table."""
    head = detail.agg(F.count(F.lit(1)).alias("detail_row_count"),
                      F.coalesce(F.sum(F.col("lost_value_net_raw").try_cast("decimal(28,6)"))
                                 .cast("double"), F.lit(0.0)).alias("lost_value_net_raw"))
    none = F.lit(None).cast("string")
    return head.select(
        F.lit(channel).alias("channel"), F.lit(period).alias("period"), F.lit(True).alias("ok"),
        F.lit("success").alias("status"), "detail_row_count",
        qa.select(F.count(F.lit(1))).scalar().alias("qa_summary_row_count"),
        unmapped.select(F.count(F.lit(1))).scalar().alias("unmapped_site_count"),
        "lost_value_net_raw", none.alias("error_type"), none.alias("error_message"))


def failure_record(spark: SparkSession, channel: str, period: str, error: Exception) -> DataFrame:
    """The row of a run that failed."""
    return spark.createDataFrame([(channel, period, False, "failed", 0, 0, 0, 0.0, type(error).__name__,
                                   str(error))], RECORD_COLUMNS)


def append_run_log(record: DataFrame, path: str) -> None:
    """Add a run's row, with the time, to the run-log table at ``path``."""
    record.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)
