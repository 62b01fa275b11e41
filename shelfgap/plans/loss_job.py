"""End-to-end loss run: model -> written detail -> reports -> QA -> read-back
(SURVEY I3, I6, I11-I13, K1-K7).

The detail and the month's day balance are written first to the output folder
and every report is computed from what was written.  That cuts the lineage (an
executor lost later recomputes from Parquet, not from the raw inputs), and the
model is evaluated once per run.

A run writes to a folder of its own and is published by one pointer after all
of it has been read back, so a run that fails leaves the earlier one readable.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import sinks
from ..operators import model as M
from ..operators import quality as Q
from ..operators import reports as R
from ..operators import stock as K
from ..profiles import ChannelProfile, ModelConfig
from ..publishing import publish, published, versions


def _excluded(seen: Observation) -> float | None:
    """The observed count; None where the plan needed none of the rows, so that it is still to be taken."""
    n = sinks.observed(seen, "excluded")
    return None if n is None else float(n)


def load_results(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The datasets of the newest published run under ``root``.

    Fails where no run has succeeded, and where a dataset of the run is gone.
    """
    now = published(spark, root)
    if now is None:
        raise ValueError(f"no run under {root} has succeeded")
    out, run = {}, now[1]
    for name, schema in run["schemas"].items():
        folder = sinks.partition_path(f"{root.rstrip('/')}/{run['run']}/{name}", run["channel"], run["period"])
        if not sinks.is_complete(spark, folder):
            raise ValueError(f"the published run lacks the dataset {name}: {folder}")
        out[name] = spark.read.schema(T.StructType.fromJson(schema)).parquet(folder)
    return out


@dataclass
class LossJobResult:
    root: str
    paths: dict[str, str]
    datasets: dict[str, DataFrame]       # read back from the written partitions
    round_trip_counts: DataFrame         # (dataset, rows)
    record: DataFrame                    # the run's row for a run log


def run_loss_job(spark: SparkSession, inputs: M.ModelInputs, cfg: ModelConfig,
                 profile: ChannelProfile, output_root: str, csv: bool = False,
                 raw_inputs: dict[str, DataFrame] | None = None, run_log: str | None = None) -> LossJobResult:
    """Write one channel's run under ``output_root``, a folder all executors share.

    With ``raw_inputs`` their fingerprints are stored with the run, so that a
    later overview can tell whether they have changed (``Q.changed_inputs``).
    """
    if not output_root:
        raise ValueError("name an output folder that all executors share")
    root = f"{output_root.rstrip('/')}/{sinks.output_name(profile, cfg.period)}"
    channel, period = profile.key, cfg.period
    paths, schemas, counts = {}, {}, {}
    run = f"run-{uuid.uuid4().hex}"

    def write(name: str, df: DataFrame) -> DataFrame:
        paths[name] = f"{root}/{run}/{name}"
        # counted by the write itself, not by a second evaluation
        seen, df = sinks.observed_rows(df)
        sinks.write_partitioned(df, paths[name], channel, period)
        schemas[name], counts[name] = sinks.written_schema(df), sinks.observed(seen, "rows") or 0
        back = sinks.read_partition(spark, paths[name], channel, period,
                                    schemas[name]).drop("channel", "period")
        if csv and name in sinks.SHEETS:
            sinks.export_csv(back, paths[name] + "_csv", name)
        return back

    def own(df: DataFrame) -> DataFrame:
        return df.filter(F.col("channel") == channel) if "channel" in df.columns else df

    inputs = M.ModelInputs(*(own(getattr(inputs, n)) for n in ("product", "orders", "stock", "site_map")))
    # two QA counts are taken in passing, by the passes that read all of a table anyway; a
    # month-partitioned stock table is read for one month only, so there the count has its own narrow scan
    order_count, stock_count = Observation(), Observation()
    weight = F.col("month_rows") if "month_rows" in inputs.orders.columns else F.lit(1)
    inputs.orders = inputs.orders.observe(
        order_count, F.coalesce(F.sum(F.when(F.col("excluded_prefix_p"), weight)), F.lit(0)).alias("excluded"))
    whole_stock = "posting_month" not in inputs.stock.columns
    stock = inputs.stock
    if whole_stock:
        stock = stock.observe(stock_count, F.count_if("excluded_prefix_p").alias("excluded"))
    day_bal = write("day_balance", K.day_balance(stock, inputs.site_map, cfg))
    counted = day_bal.withColumn("channel", F.lit(channel))
    detail = write("detail", sinks.with_comments(M.loss_detail(inputs, cfg, counted).drop("channel"),
                                                 sinks.DETAIL_COMMENTS))
    unmapped = write("unmapped_sites", K.unmapped_sites(inputs.stock, inputs.site_map, cfg).drop("channel"))
    out = {
        "detail": detail,
        "unmapped_sites": unmapped,
        "summary_total": write("summary_total", R.summary_total(detail)),
        "summary_site": write("summary_site", R.summary_site(detail)),
        "summary_sku": write("summary_sku", R.summary_sku(detail, M.site_names(inputs.site_map, channel))),
        "calculation_example": write("calculation_example", R.calculation_example(detail)),
        "qa_summary": write("qa_summary", Q.qa_summary(
            inputs, cfg, detail=detail, unmapped=unmapped, day_bal=day_bal, excluded_orders=_excluded(order_count),
            excluded_stock=_excluded(stock_count) if whole_stock else None)),
    }
    if raw_inputs:
        write("input_fingerprints", Q.fingerprints(raw_inputs))
    sinks.verify_written(spark, counts, paths, channel, period, schemas)
    content = {n: T.StructType([f for f in x.fields if f.name not in ("channel", "period")]).jsonValue()
               for n, x in schemas.items()}
    publish(spark, root, max(versions(spark, root), default=0) + 1,
            {"run": run, "channel": channel, "period": period, "schemas": content})
    totals = reduce(DataFrame.unionByName, [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("dataset"), "rows")
        for name, df in out.items()])
    record = Q.run_record(detail, out["qa_summary"], unmapped, channel, period)
    if run_log:
        Q.append_run_log(record, run_log)
    return LossJobResult(root=root, paths=paths, datasets=out, round_trip_counts=totals, record=record)
