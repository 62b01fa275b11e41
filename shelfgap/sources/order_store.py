"""A maintained store of order lines, appended month by month.

Lines are kept distinct and partitioned by purchase month.  Equal lines have the
same date, so an append needs a distinct of the new lines and, of the store, of
the months in both alone; all other months pass untouched.  Beside the lines
stand their sums per month, SKU, site and name, brought up to date for the
changed months: windows start and end with months, so the model's totals follow
from them without reading a line.

An append writes beside what is there and then publishes which folder holds each
month, so readers see all of it or nothing, and a failed append changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import month_bucket
from ..publishing import publish, published
from .readers import list_folder

LINES, SUMS = "lines", "sums"
SLICES = 8      # tasks, and so files, that a month's rows are dealt to
MONTH, WRITTEN = "purchase_month", "written"


def _identity(lines: DataFrame) -> list[str]:
    """The columns that make a line: where it stood in a file is not among them."""
    return [c for c in lines.columns if c not in ("row_ord", MONTH, WRITTEN)]


def _sliced(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` dealt out by month and, within it, by ``keys``: grouping by all of these and writing by
    month then move no row again."""
    return (df.withColumn("_slice", F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(SLICES)))
            .repartition(MONTH, "_slice"))


def distinct_lines(lines: DataFrame) -> DataFrame:
    """Each line once, at its first place where places are known."""
    keys = _identity(lines)
    if "row_ord" not in lines.columns:
        return _sliced(lines.select(*keys, MONTH), keys).distinct().drop("_slice")
    return _sliced(lines, keys).groupBy(*keys, MONTH, "_slice").agg(F.min("row_ord").alias("row_ord")).drop("_slice")


def month_sums(lines: DataFrame) -> DataFrame:
    """Quantities, values and first place per (month, sku, site, name)."""
    sums = [F.sum("quantity").alias("month_qty"), F.sum("gross").alias("month_gross"),
            F.sum("net").alias("month_net"), F.count(F.lit(1)).alias("month_rows")]
    if "row_ord" in lines.columns:
        sums.append(F.min("row_ord").alias("row_ord"))
    keys = ["sku", "stock_code", "product_name", "excluded_prefix_p"]
    return _sliced(lines, keys).groupBy(MONTH, *keys, "_slice").agg(*sums).drop("_slice")


def _write(df: DataFrame, root: str, kind: str, written: int) -> list[str]:
    """One folder per month; the months that were written, from the folder's listing."""
    path = f"{root}/{kind}/{WRITTEN}={written}"
    # the rows come dealt out by month and slice: few files per month, and a large month's in several tasks
    df.write.mode("overwrite").partitionBy(MONTH).parquet(path)
    names = list_folder(df.sparkSession, path) or []
    return [n.split("=", 1)[1] for n in names if n.startswith(f"{MONTH}=")]


def _read(spark: SparkSession, root: str, kind: str, schema, places: dict[str, int]) -> DataFrame:
    if not places:
        return spark.createDataFrame([], schema)
    paths = [f"{root}/{kind}/{WRITTEN}={w}/{MONTH}={m}" for m, w in sorted(places.items())]
    return (spark.read.schema(schema).option("basePath", f"{root}/{kind}").parquet(*paths)
            .select(*schema.fieldNames()))


def _schema(df: DataFrame):
    own = [f for f in df.schema.fields if f.name != MONTH]
    return T.StructType([T.StructField(f.name, f.dataType) for f in own] + [T.StructField(MONTH, T.StringType())])


def append(spark: SparkSession, root: str, orders: DataFrame) -> int:
    """Add normalised order lines to the store under ``root``; the published version.

    The first append makes the store.  Lines without a place in a file keep none;
    of equal lines the place in the earlier append counts.  An append of nothing
    publishes nothing new.
    """
    root = root.rstrip("/")
    now = published(spark, root)
    version = now[0] + 1 if now else 1
    places = {kind: dict(now[1][kind]) if now else {} for kind in (LINES, SUMS)}
    new = orders.drop(MONTH, WRITTEN).withColumn(MONTH, month_bucket(F.to_date("purchase_date")))
    if "row_ord" in new.columns:
        new = new.withColumn("row_ord", F.struct(F.lit(version).alias("append"), F.col("row_ord").alias("place")))
    schema = _schema(new)
    if now and T.StructType.fromJson(now[1]["schema"]) != schema:
        raise ValueError("the store under this root holds lines of other columns or types")
    settled, merged = 2 * version, 2 * version + 1
    months = _write(distinct_lines(new), root, LINES, settled)
    both = {m: places[LINES][m] for m in months if m in places[LINES]}
    changed = {m: settled for m in months}
    if both:
        old = _read(spark, root, LINES, schema, both)
        fresh = _read(spark, root, LINES, schema, {m: settled for m in both})
        for m in _write(distinct_lines(old.unionByName(fresh)), root, LINES, merged):
            changed[m] = merged
    if not changed:
        if now is None:
            publish(spark, root, version, {LINES: {}, SUMS: {}, "schema": schema.jsonValue()})
        return version if now is None else now[0]
    _write(month_sums(_read(spark, root, LINES, schema, changed)), root, SUMS, settled)
    places[LINES].update(changed)
    places[SUMS].update({m: settled for m in changed})
    publish(spark, root, version, {**places, "schema": schema.jsonValue()})
    return version


def _published(spark: SparkSession, root: str) -> dict:
    now = published(spark, root.rstrip("/"))
    if now is None:
        raise ValueError(f"no order store has been published under {root}")
    return now[1]


def lines(spark: SparkSession, root: str) -> DataFrame:
    """The store's order lines, with the month as a partition column."""
    state = _published(spark, root)
    return _read(spark, root.rstrip("/"), LINES, T.StructType.fromJson(state["schema"]), state[LINES])


def sums(spark: SparkSession, root: str) -> DataFrame:
    """The store's sums per month, for ``ModelInputs.orders`` in place of the lines."""
    state = _published(spark, root)
    schema = T.StructType.fromJson(state["schema"])
    shape = _schema(month_sums(spark.createDataFrame([], schema)))
    return _read(spark, root.rstrip("/"), SUMS, shape, state[SUMS])
