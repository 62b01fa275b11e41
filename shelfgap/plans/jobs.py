"""File-driven entry points: the batch run users start.

``InputPaths`` names the four inputs of a channel (plus an optional
current-month orders file that is appended with UNION DISTINCT).  The format
of an input is said, not guessed: ``format`` (or ``formats`` per input) is
"parquet", "text" (delimited) or "workbook" (a folder with a file per sheet).
Paths may lie in any store that Spark reads.  Everything after the read is
lazy until the loss job writes its datasets.
"""

from __future__ import annotations

import argparse
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import model as M
from ..operators import quality as Q
from ..profiles import ChannelProfile, ModelConfig, get_profile
from ..sources import loaders as L
from ..sources import readers as RD
from ..sources.contracts import SLOT_LABELS, SLOTS, contract_for
from .loss_job import LossJobResult, run_loss_job

FORMATS = ("parquet", "text", "workbook")


@dataclass(frozen=True)
class InputPaths:
    orders: str
    daily_stock: str
    site_mapping: str
    product: str
    channel: str = "th"
    orders_actual: str | None = None
    format: str = "text"
    formats: Mapping[str, str] = field(default_factory=dict)   # by input name, where it differs

    def format_of(self, name: str) -> str:
        chosen = self.formats.get(name, self.format)
        if chosen not in FORMATS:
            raise ValueError(f"{name}: the format {chosen!r} is not one of {', '.join(FORMATS)}")
        return chosen


def with_file_order(df: DataFrame) -> DataFrame:
    """Attach ``row_ord``, the place in the files (``readers.file_place``).

    Used to break "first row" ties (F1, F2, E4) the way the reference's file order does.
    """
    return df.withColumn("row_ord", RD.file_place())


def read_orders(spark: SparkSession, path: str, channel: str, fmt: str = "text") -> DataFrame:
    """A1-A3: a channel without sales sheets has the UTF-16 export (or Parquet
    landed from it, or the first sheet of a workbook folder); the others their
    sales sheet, with a title row above the header."""
    profile = get_profile(channel)
    if fmt == "parquet":
        return spark.read.parquet(path)
    sheets = profile.sheets_of("sales")
    if not sheets:
        if fmt == "workbook":                                    # A2: first sheet
            have = RD.available_sheets(spark, path)
            if not have:
                raise ValueError(f"{path} holds no sheets")
            return RD.read_sheet_table(spark, RD.sheet_path(path, have[0]), header_row=0)
        return RD.read_orders_export(spark, path)
    read = RD.read_workbook_sheets(spark, path, sheets, contract_for("sales", profile).header_row)
    return reduce(DataFrame.unionByName, read.values())


def read_products(spark: SparkSession, path: str, channel: str, fmt: str = "text"):
    """A product CSV, or the channel's product sheets."""
    profile = get_profile(channel)
    sheets = profile.sheets_of("sku_live")
    if not sheets:
        return read_table(spark, path, fmt=fmt)
    return RD.read_workbook_sheets(spark, path, sheets, contract_for("sku_live", profile).header_row)


def read_table(spark: SparkSession, path: str, sheet: str | None = None, fmt: str = "text") -> DataFrame:
    """Parquet, a delimited file, or the sheet of a workbook folder."""
    if fmt == "workbook":
        if sheet is None:
            raise ValueError(f"{path}: name the sheet of the workbook to read")
        return RD.read_sheet_table(spark, RD.sheet_path(path, sheet), header_row=0)
    return spark.read.parquet(path) if fmt == "parquet" else RD.read_delimited(spark, path)


# --- fixed value: the site-map sheet of a workbook ------------------------
SITE_MAP_SHEET = "Include"
# ---------------------------------------------------------------------------


def register_views(inputs: M.ModelInputs, prefix: str = "") -> list[str]:
    """Expose the normalized inputs as temp views for ad-hoc SQL."""
    names = []
    for name in ("product", "orders", "stock", "site_map"):
        view = f"{prefix}{name}"
        getattr(inputs, name).createOrReplaceTempView(view)
        names.append(view)
    return names


def suggest_month_from_path(spark: SparkSession, stock_path: str, fmt: str = "text") -> DataFrame:
    """Month suggestion reading only the posting_date column."""
    from ..functions.dates import with_month_first_timestamp
    from ..operators.quality import month_suggestion
    raw = read_table(spark, stock_path, fmt=fmt).select("posting_date")
    days = with_month_first_timestamp(raw, "posting_date", "_day").select(F.to_date("_day").alias("posting_date"))
    return month_suggestion(days)


def _ordered(x):
    if isinstance(x, dict):
        return {k: with_file_order(v) for k, v in x.items()}
    return x if "row_ord" in x.columns else with_file_order(x)


def load_inputs(spark: SparkSession, paths: InputPaths, site_profile: ChannelProfile | None = None) -> M.ModelInputs:
    """The four inputs, normalised; ``site_profile`` says which sites count where not the channel's own."""
    channel = get_profile(paths.channel).key
    orders = L.load_orders(_ordered(read_orders(spark, paths.orders, channel, paths.format_of("orders"))), channel)
    if paths.orders_actual:
        current = L.load_orders(_ordered(read_orders(spark, paths.orders_actual, channel,
                                                     paths.format_of("orders_actual"))), channel)
        orders = L.append_orders(orders, current)          # I12 / F5
    return M.ModelInputs(
        product=L.load_products(_ordered(read_products(spark, paths.product, channel,
                                                       paths.format_of("product"))), channel),
        orders=orders,
        stock=L.load_daily_stock(read_table(spark, paths.daily_stock, fmt=paths.format_of("daily_stock"))),
        site_map=L.load_site_map(read_table(spark, paths.site_mapping, SITE_MAP_SHEET,
                                            paths.format_of("site_mapping")), site_profile or channel),
    )


def load_channels(spark: SparkSession, channels: Sequence[InputPaths]) -> M.ModelInputs:
    """Each channel's own orders, products, stock and map as one set of inputs, keyed by ``channel``."""
    each = [(get_profile(p.channel).key, load_inputs(spark, p)) for p in channels]

    def together(name: str) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                      [L.for_channel(getattr(i, name), key) for key, i in each])

    return M.ModelInputs(*(together(n) for n in ("product", "orders", "stock", "site_map")))


def check_paths(spark: SparkSession, paths: InputPaths) -> DataFrame:
    """I4: findings of a channel's inputs, those that keep an input from being read included.

    Codes of this kind: missing_staged_path (no path given), missing_staged_file
    (nothing there), unsupported_format, unreadable_file.
    """
    profile = get_profile(paths.channel)
    read = {"sales": ("orders", lambda f: read_orders(spark, paths.orders, profile, f)),
            "stock": ("daily_stock", lambda f: read_table(spark, paths.daily_stock, fmt=f)),
            "sku_live": ("product", lambda f: read_products(spark, paths.product, profile, f)),
            "site_mapping": ("site_mapping", lambda f: read_table(spark, paths.site_mapping, SITE_MAP_SHEET, f))}
    parts, broken = [], []
    for slot in SLOTS:
        name, open_it = read[slot]
        path, label = getattr(paths, name), SLOT_LABELS[slot]
        if not path:
            broken.append((slot, "error", "missing_staged_path", f"{label}: no path was given."))
        elif not RD.path_exists(spark, path):
            broken.append((slot, "error", "missing_staged_file", f"{label}: there is nothing at {path}."))
        elif paths.formats.get(name, paths.format) not in FORMATS:
            broken.append((slot, "error", "unsupported_format", f"{label}: use one of {', '.join(FORMATS)}."))
        else:
            try:
                frames = open_it(paths.format_of(name))
                frames = list(frames.values()) if isinstance(frames, dict) else [frames]
                for frame in frames:
                    frame.limit(1).count()          # the first block of a file that is no such format fails
                parts += [Q.dataset_findings(slot, frame, profile) for frame in frames]
            except (PySparkException, Py4JJavaError, ValueError) as e:
                broken.append((slot, "error", "unreadable_file",
                               f"{label}: cannot be read: {str(e).strip().splitlines()[0]}"))
    return reduce(DataFrame.unionByName, parts, spark.createDataFrame(broken, Q.FINDING_SCHEMA))


def run_from_paths(spark: SparkSession, paths: InputPaths, cfg: ModelConfig, output_root: str,
                   csv: bool = True, run_log: str | None = None) -> LossJobResult:
    """The batch run: read, normalize, model, write every report dataset.

    With ``run_log`` the outcome is appended to that table, failures too; a
    failure is raised after it is logged.
    """
    profile = get_profile(paths.channel)
    try:
        inputs = load_inputs(spark, paths)
        if inputs.site_map.limit(1).count() == 0:
            raise ValueError(f"the site map has no active row for channel {profile.label}")
        return run_loss_job(spark, inputs, cfg, profile, output_root, csv=csv, run_log=run_log)
    except Exception as error:
        if run_log:
            Q.append_run_log(Q.failure_record(spark, profile.key, cfg.period, error), run_log)
        raise


def parse_arguments(argv: Sequence[str] | None = None) -> tuple[InputPaths, ModelConfig, argparse.Namespace]:
    """Parameters of a batch run from a command line."""
    p = argparse.ArgumentParser(prog="python -m shelfgap.plans.jobs")
    for name in ("orders", "daily-stock", "site-map", "product", "output"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--orders-actual", help="orders of the current month, appended")
    p.add_argument("--channel", default="th")
    p.add_argument("--format", default="text", choices=FORMATS)
    p.add_argument("--eval-year", type=int, required=True)
    p.add_argument("--eval-month", type=int, required=True)
    p.add_argument("--baseline-months", type=int, default=6)
    p.add_argument("--fallback-months", type=int, default=6)
    p.add_argument("--all-skus", action="store_true", help="not only live SKUs")
    p.add_argument("--keep-loss-when-sold", action="store_true")
    p.add_argument("--run-log", help="Parquet table to append the outcome to")
    p.add_argument("--no-csv", action="store_true")
    a = p.parse_args(argv)
    cfg = ModelConfig(a.eval_year, a.eval_month, a.baseline_months, a.fallback_months,
                      use_live_skus_only=not a.all_skus, loss_only_when_actual_zero=not a.keep_loss_when_sold)
    return InputPaths(a.orders, a.daily_stock, a.site_map, a.product, get_profile(a.channel).key,
                      a.orders_actual, a.format), cfg, a


def main(argv: Sequence[str] | None = None) -> None:
    from ..session import build_session
    paths, cfg, a = parse_arguments(argv)
    run_from_paths(build_session(app_name="shelfgap-run"), paths, cfg, a.output, csv=not a.no_csv,
                   run_log=a.run_log)


if __name__ == "__main__":
    main()
