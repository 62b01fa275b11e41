"""File readers for the four inputs.

Every text source is read with inference off (all columns string); typing is
done by the loaders with ``try_cast`` so bad values become nulls/zeros instead
of failing the job.  A "workbook" is a folder with one delimited file per sheet
(``<folder>/<sheet name>.csv``); XLSX bytes are not parsed.
"""

from __future__ import annotations

import csv
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


# a quote inside a quoted field is written twice, as in RFC 4180
QUOTING = {"quote": '"', "escape": '"'}


def read_delimited(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8",
                   multiline: bool = False) -> DataFrame:
    """CSV/TSV with a header line; every column as string."""
    return (spark.read
            .option("header", True)
            .option("inferSchema", False)
            .option("sep", sep)
            .option("encoding", encoding)
            .option("multiLine", multiline)
            .options(**QUOTING)
            .csv(path))


def natural_name(path: Column) -> Column:
    """A path whose numbers compare by value: part-2 stands before part-10."""
    padded = F.regexp_replace(path, "([0-9]+)", "0" * 20 + "$1")
    return F.regexp_replace(padded, "[0-9]*([0-9]{20})", "$1")


def file_place() -> Column:
    """Where a row stands: its file in natural order, the start of its split, and the place there.

    Spark packs splits into partitions by size, so row numbers alone would follow neither the
    files' order nor that of a large file's splits.  For frames read from files only.
    """
    return in_natural_order(written_place())


def written_place() -> Column:
    """``file_place`` with the file's written name, which costs a row nothing; its order is not natural."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                    F.monotonically_increasing_id().alias("line"))


def in_natural_order(place: Column | str) -> Column:
    """``file_place`` from a ``written_place``: the name is padded by the row, so only where it is needed."""
    place = F.col(place) if isinstance(place, str) else place
    return F.struct(natural_name(place["file"]).alias("file"), place["split"].alias("split"),
                    place["line"].alias("line"))


CHUNK_BITS = 12             # 4,096 lines are moved as one row; a line's number in its chunk has three hex digits
ESCAPE = "\u0001"           # a 0 follows it where it stands in a chunk's text, a 1 where it ends a record


def read_quoted_records(spark: SparkSession, path: str, names: list[str], sep: str, encoding: str,
                        quote: str = '"') -> DataFrame:
    """Delimited records whose quoted fields may hold line ends, read by many tasks.

    A line end inside quotes ends no record, and whether a line starts inside
    quotes depends on all lines before it.  A task puts the lines of its split
    together to chunks of some thousand lines (``_line_chunks``), and only these
    are moved, once.  Then

    1. the number of lines with an odd number of quotes in the chunks before
       tells whether a chunk starts inside quotes,
    2. if it does, its lines up to the first odd one belong to a record of a
       chunk before; if it ends inside quotes, its lines from the last odd one
       on begin a record that a later chunk ends (``_crossing_records``),
    3. the lines between are whole records (``_whole_records``).

    That number, halved, numbers the records that cross chunks, so their lines
    (and no others) are brought together, also over the border of splits.  Each
    file's header line is left out.  Quotes must come in pairs, as RFC 4180
    asks.  ``row_ord`` is the place of a record's first line.
    """
    chunks = _line_chunks(spark, path, encoding)
    # what is found of a chunk goes to where its text is; both read the chunks as they were moved
    chunks = chunks.join(_found_in_chunks(chunks, quote).hint("shuffle_hash"), ["path", "split", "chunk"])
    records = _whole_records(chunks, quote).unionByName(_crossing_records(chunks))
    # as in Spark's own reader of such files, line ends inside quotes become line feeds
    text = F.when(F.endswith("text", F.lit("\r")), F.regexp_replace("text", "\r$", "")).otherwise(F.col("text"))
    records = records.withColumn("text", F.replace(text, F.lit("\r\n"), F.lit("\n")))
    schema = T.StructType([T.StructField(n, T.StringType(), True) for n in names])
    fields = F.from_csv(F.col("text"), _ddl(schema),
                        {"sep": sep, "multiLine": "true", "mode": "PERMISSIVE", **QUOTING})
    return (records.where("text <> ''")
            .select(fields.alias("f"), "row_ord").select("f.*", "row_ord"))


def _line_chunks(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """The lines of files, put together within each split: ``path``, ``split``, ``chunk`` and ``texts``, its lines in
    order, each behind its number in the chunk.

    A split is read by one task, so a chunk is whole before it is moved.
    """
    raw = (spark.read.option("encoding", encoding).option("lineSep", "\n").text(path)
           .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"),
                   F.monotonically_increasing_id().alias("line"),
                   F.decode(F.col("value").cast("binary"), encoding).alias("text")))
    marked = F.startswith("text", F.lit("\ufeff"))
    text = F.when(marked, F.expr("substring(text, 2)")).otherwise(F.col("text"))
    place = F.lpad(F.hex(F.col("line").bitwiseAND(2 ** CHUNK_BITS - 1)), 3, "0")
    lines = raw.select("path", "split", F.shiftright("line", CHUNK_BITS).alias("chunk"), F.concat(place, text).alias("text"))
    return (lines.groupBy("path", "split", "chunk").agg(F.collect_list("text").alias("texts"))
            .withColumn("texts", F.sort_array("texts")))


def _found_in_chunks(chunks: DataFrame, quote: str) -> DataFrame:
    """What a chunk's place in its file says of its lines.

    The first ``skip`` lines are no record of this chunk: they are the file's header line or the ``closed`` ones, which
    belong to the record ``number`` of a chunk before; the last ``opened`` lines begin the record ``next_number``.
    """
    keys = ["path", "split", "chunk"]
    quotes = F.transform("texts", lambda t: (F.length(t) - F.length(F.replace(t, F.lit(quote), F.lit("")))) % 2)
    found = (chunks.select(*keys, quotes.alias("odds"))
             .select(*keys, F.size("odds").alias("lines"),
                     F.aggregate("odds", F.lit(0), lambda n, odd: n + odd).alias("odd"),
                     F.array_position("odds", 1).cast("int").alias("first"),
                     (F.size("odds") + 1 - F.array_position(F.reverse("odds"), 1)).cast("int").alias("last")))
    before = Window.partitionBy("path").orderBy("split", "chunk")
    start = F.coalesce(F.sum("odd").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = found.withColumns({"start": start, "header": (F.row_number().over(before) == 1).cast("int")})
    inside = F.col("start") % 2 == 1
    closed = F.when(inside, F.when(F.col("odd") > 0, F.col("first")).otherwise(F.col("lines"))).otherwise(0)
    opens = (F.col("odd") > 0) & ((F.col("start") + F.col("odd")) % 2 == 1)
    found = found.withColumns({"closed": closed, "skip": F.when(inside, closed).otherwise(F.col("header"))})
    opened = F.when(opens, F.col("lines") - F.greatest(F.col("last") - 1, F.col("skip"))).otherwise(0)
    return found.select(*keys, natural_name(F.col("path")).alias("file"), "skip", "closed", opened.alias("opened"),
                        F.shiftright("start", 1).alias("number"),
                        F.shiftright(F.col("start") + F.col("odd"), 1).alias("next_number"))


def _line_of(text: Column) -> Column:
    """The place of a line from its chunk and the number before its text."""
    return F.shiftleft("chunk", CHUNK_BITS) + F.conv(F.substring(text, 1, 3), 16, 10).cast("long")


def _whole_records(chunks: DataFrame, quote: str) -> DataFrame:
    """(row_ord, text) of the records that lie within a chunk.

    The lines between those of crossing records start and end outside quotes.  Cut at quotes, the first piece and
    every second one are outside, and only there a line end ends a record.
    """
    inner = F.slice("texts", F.col("skip") + 1, F.size("texts") - F.col("skip") - F.col("opened"))
    pieces = F.split(F.replace(F.array_join(inner, "\n"), F.lit(ESCAPE), F.lit(ESCAPE + "0")), re.escape(quote))
    pieces = F.transform(pieces, lambda piece, i: F.when(i % 2 == 0, F.replace(piece, F.lit("\n"), F.lit(ESCAPE + "1")))
                         .otherwise(piece))
    # the numbers of a record's later lines go; that of its first gives its place
    whole = F.regexp_replace(F.array_join(pieces, quote), "\n[0-9A-F]{3}", "\n")
    records = chunks.select("file", "split", "chunk", F.explode(F.split(whole, ESCAPE + "1")).alias("piece"))
    return (records.where("piece <> ''")     # of chunks without such lines
            .select(F.struct("file", "split", _line_of(F.col("piece")).alias("line")).alias("row_ord"),
                    F.replace(F.substring("piece", 4, 2 ** 31 - 1), F.lit(ESCAPE + "0"), F.lit(ESCAPE)).alias("text")))


def _crossing_records(chunks: DataFrame) -> DataFrame:
    """(row_ord, text) of the records that cross chunks, of which a chunk holds the end, the beginning or a part."""
    ends = F.slice("texts", F.lit(1), F.col("closed"))
    begins = F.slice("texts", F.size("texts") - F.col("opened") + 1, F.col("opened"))

    def of(number: str, lines: Column) -> Column:
        return F.transform(lines, lambda line: F.struct(F.col(number).alias("number"), line.alias("piece")))

    parts = (chunks.where("closed > 0 or opened > 0")
             .select("path", "file", "split", "chunk",
                     F.explode(F.concat(of("number", ends), of("next_number", begins))).alias("part"))
             .select("path", "file", "part.number",
                     F.struct("split", _line_of(F.col("part.piece")).alias("line"),
                              F.substring("part.piece", 4, 2 ** 31 - 1).alias("text")).alias("part")))
    return (parts.groupBy("path", "number").agg(F.array_sort(F.collect_list("part")).alias("parts"), F.first("file").alias("file"))
            .select(F.struct("file", F.col("parts")[0]["split"].alias("split"),
                             F.col("parts")[0]["line"].alias("line")).alias("row_ord"),
                    F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text")))


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` string" for f in schema.fields)


def read_orders_export(spark: SparkSession, path: str, multiline: bool = False,
                       quoted_newlines: bool = False) -> DataFrame:
    """A1: UTF-16 tab-separated order export, split across tasks.

    Spark's default line reader splits on the byte 0x0A, which cuts UTF-16 code
    units apart; with the encoding's byte order and an explicit line separator
    the reader splits on the encoded newline instead, so one large export is
    read by many tasks.  The byte order comes from the BOM seen in the header;
    the BOM and a CR before the line end are removed.  With ``quoted_newlines``
    quoted fields may hold line ends and the export is still read by many tasks
    (``read_quoted_records``); ``multiline=True`` is the single-task reader of the same.
    """
    if multiline:
        return read_delimited(spark, path, sep="\t", encoding="UTF-16", multiline=True)

    def read(encoding: str) -> DataFrame:
        return (spark.read.option("header", True).option("inferSchema", False)
                .option("sep", "\t").option("encoding", encoding).option("lineSep", "\n")
                .options(**QUOTING).csv(path))

    encoding = "UTF-16LE"
    df = read(encoding)
    if df.columns and df.columns[0].startswith("\ufffe"):   # BOM read backwards
        encoding = "UTF-16BE"
        df = read(encoding)
    names = [c.lstrip("\ufeff").rstrip("\r") for c in df.columns]
    if quoted_newlines:
        return read_quoted_records(spark, path, names, "\t", encoding)
    df = df.toDF(*names)
    last = names[-1]
    return df.withColumn(last, F.regexp_replace(F.col(f"`{last}`"), "\r$", ""))


def read_sheet_table(spark: SparkSession, path: str, header_row: int = 1,
                     multiline: bool = False) -> DataFrame:
    """A4: one sheet exported as one delimited file with ``header_row`` title lines.

    The first ``header_row + 1`` lines are read (a bounded ``limit``) to learn
    the column names from the header line; the data is then read with that
    all-string schema, the first line skipped by the reader and the remaining
    leading lines (header / further titles) dropped by value.  The read is
    splittable (a large sales sheet is read by many tasks) unless
    ``multiline`` is asked for quoted fields that contain newlines.
    """
    lead = [r["value"] for r in spark.read.text(path).limit(header_row + 1).collect()]
    if len(lead) <= header_row:
        raise ValueError(f"Sheet table {path} has no header row")
    parsed = [next(csv.reader([line])) if line else [] for line in lead]
    names = [n if n else f"_c{i}" for i, n in enumerate(parsed[header_row])]
    schema = T.StructType([T.StructField(n, T.StringType(), True) for n in names])
    data = (spark.read.schema(schema).option("header", True).option("multiLine", multiline)
            .options(**QUOTING).csv(path))
    for values in parsed[1:]:
        padded = (values + [None] * len(names))[:len(names)]
        same = F.lit(True)
        for n, v in zip(names, padded):
            c = F.col(f"`{n}`")
            same = same & (c.isNull() if v in (None, "") else c.eqNullSafe(F.lit(v)))
        data = data.filter(~same)
    return data


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder in whatever store the path names."""
    where, fs = _file_system(spark, path)
    return fs.exists(where)


def list_folder(spark: SparkSession, path: str) -> list[str] | None:
    """Names in a folder of any store that Spark reads; None if it is no folder (metadata only)."""
    where, fs = _file_system(spark, path)
    if not fs.exists(where) or not fs.getFileStatus(where).isDirectory():
        return None
    return sorted(x.getPath().getName() for x in fs.listStatus(where))


def sheet_path(workbook_dir: str, sheet: str) -> str:
    return f"{workbook_dir.rstrip('/')}/{sheet}.csv"


def available_sheets(spark: SparkSession, workbook_dir: str) -> list[str]:
    """Sheet names present in a workbook folder (metadata only)."""
    return [n[:-4] for n in list_folder(spark, workbook_dir) or [] if n.endswith(".csv")]


def missing_sheets(available: list[str], required: tuple[str, ...]) -> list[str]:
    """A5: sheets a profile needs that the workbook lacks."""
    have = set(available)
    return [s for s in required if s not in have]


def read_workbook_sheets(spark: SparkSession, workbook_dir: str, sheets: tuple[str, ...],
                         header_row: int = 1) -> dict[str, DataFrame]:
    gaps = missing_sheets(available_sheets(spark, workbook_dir), sheets)
    if gaps:
        raise ValueError(f"Workbook missing sheets: {gaps}")
    return {s: read_sheet_table(spark, sheet_path(workbook_dir, s), header_row) for s in sheets}


# --- rejected lines: what is wrong with a line that is no record of its file ------
GOOD, SHORT, LONG, QUOTING_WRONG, UNDECODABLE = "good", "short", "long", "quoting", "undecodable"


def read_checked(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """A delimited file with ``_line``, ``_state`` and ``_place``: no line is dropped or filled up unseen.

    A line of fewer or more fields than the header is ``short`` or ``long``, one
    whose quotes do not close ``quoting``, and one with bytes that the encoding
    does not know ``undecodable``; all others are ``good``.  ``_line`` is the
    text of a line of the first three kinds, ``_place`` where it stands.
    """
    checked = _checked(spark, path, sep, encoding)
    return checked.withColumn("_place", in_natural_order("_place"))


def _checked(spark: SparkSession, path: str, sep: str, encoding: str) -> DataFrame:
    """``read_checked`` with files by their written names."""
    names = read_delimited(spark, path, sep, encoding).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_line"]])
    rows = (spark.read.schema(schema).option("header", True).option("sep", sep).option("encoding", encoding)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_line").option("columnPruning", False)
            .options(**QUOTING).csv(path))
    unquoted = F.regexp_replace("_line", '"(?:[^"]|"")*"', "")
    fields = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(sep), F.lit(""))) + 1
    strange = F.lit(False)
    for n in names:
        strange = strange | F.coalesce(F.contains(F.col(f"`{n}`"), F.lit("\ufffd")), F.lit(False))
    broken = F.col("_line").isNotNull()
    state = (F.when(broken & unquoted.contains('"'), QUOTING_WRONG).when(broken & (fields < len(names)), SHORT)
             .when(broken & (fields > len(names)), LONG).when(broken, QUOTING_WRONG)
             .when(strange, UNDECODABLE).otherwise(GOOD))
    return rows.withColumn("_state", state).withColumn("_place", written_place())


def land_checked(spark: SparkSession, path: str, out: str, sep: str = ",", encoding: str = "UTF-8") -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected lines) of a delimited file, landed by one pass under ``out``.

    Rejected lines keep what could be read of them, their text, their place and what is wrong.
    Places are landed with the files' written names and put in natural order where they are read.
    """
    checked = _checked(spark, path, sep, encoding)
    checked.write.mode("overwrite").partitionBy("_state").parquet(out)
    schema = T.StructType([*[f for f in checked.schema if f.name != "_state"], checked.schema["_state"]])
    landed = spark.read.schema(schema).parquet(out).withColumn("_place", in_natural_order("_place"))
    good = landed.where(F.col("_state") == GOOD).withColumnRenamed("_place", "row_ord").drop("_line", "_state")
    return good, landed.where(F.col("_state") != GOOD)


def land_by_sku(df: DataFrame, path: str, buckets: int, partition_by: list[str] | None = None) -> DataFrame:
    """Store a table once bucketed by ``sku``, so that grouping and joining by it needs no exchange.

    The files lie under ``path``; the table is known to this session's catalog by a name of its own.
    """
    name = f"shelfgap_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("path", path).bucketBy(buckets, "sku").sortBy("sku")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def land_stock_by_month(raw_stock: DataFrame, path: str) -> str:
    """Store a daily-stock table partitioned by ``posting_month`` (yyyy-MM of the
    month-first reading of ``posting_date``), so the evaluation-month filter
    prunes whole partitions instead of scanning every month."""
    from ..functions.dates import month_bucket, with_month_first_timestamp
    read = with_month_first_timestamp(raw_stock, "posting_date", "posting_month")
    return land_as_parquet(read.withColumn("posting_month", month_bucket(F.to_date("posting_month"))), path,
                           ["posting_month"])


def land_orders_by_month(raw_orders: DataFrame, path: str) -> str:
    """Store order lines partitioned by ``purchase_month`` (yyyy-MM of the
    best-coverage reading of ``Purchase Date``): queries that only need the
    baseline windows then read 13 months instead of the whole history."""
    from ..functions.dates import month_bucket, with_best_timestamp
    read = with_best_timestamp(raw_orders, "Purchase Date", "purchase_month")
    return land_as_parquet(read.withColumn("purchase_month", month_bucket(F.to_date("purchase_month"))), path,
                           ["purchase_month"])


def land_as_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Write a source once to Parquet so later reads are splittable and pruned."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path
