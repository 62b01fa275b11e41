"""Date parsing and month helpers.

B8 -- the reference parses a whole text column twice (month-first and
day-first) and keeps the reading that parses strictly more rows.  Here both
readings are column expressions and the choice is a scalar subquery over the
same input, so it stays one lazy plan: no collect, no driver loop.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

# --- fixed values: accepted text layouts -----------------------------------
_TIME = (r"(?:[ T]+([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.][0-9]{1,9})?)?\s*([AaPp][Mm])?"
         r"\s*(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?")
_YEAR = "([0-9]{4}|[0-9]{2})"
_NAME = "([A-Za-z]{3,9})"
YEAR_FIRST = "^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})" + _TIME + "$"
COMPACT = "^([0-9]{4})([0-9]{2})([0-9]{2})" + _TIME + "$"
NUMERIC = "^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]" + _YEAR + _TIME + "$"
DAY_NAME = "^([0-9]{1,2})[- /.]+" + _NAME + "[- /.,]+" + _YEAR + _TIME + "$"
NAME_DAY = "^" + _NAME + "[- /.]+([0-9]{1,2})(?:st|nd|rd|th)?[- /.,]+" + _YEAR + _TIME + "$"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october",
          "november", "december")
# two-digit years up to this one are in the 2000s, as in the C library's rule
PIVOT_YEAR = 68
# ---------------------------------------------------------------------------


def _stamp(p: Column) -> Column:
    """Timestamp of [year, month, day, hour, minute, second, am/pm], all texts; null if there is none."""
    year, hour, half = p[0].try_cast("int"), F.coalesce(p[3].try_cast("int"), F.lit(0)), F.lower(p[6])
    year = F.when(F.length(p[0]) > 2, year).when(year <= PIVOT_YEAR, year + 2000).otherwise(year + 1900)
    # a month is written whole or by its first three letters, September also by four
    names = {n: i for i, m in enumerate(MONTHS, 1) for n in (m, m[:3])} | {"sept": 9}
    known = F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair])
    month = F.coalesce(p[1].try_cast("int"), F.try_element_at(known, F.lower(p[1])))
    hour = (F.when(half == "", hour).when((hour < 1) | (hour > 12), F.lit(99))
            .when(half == "am", hour % 12).otherwise(hour % 12 + 12))
    minute, second = (F.coalesce(p[i].try_cast("int"), F.lit(0)) for i in (4, 5))
    written = F.format_string("%04d-%02d-%02d %02d:%02d:%02d", year, month, p[2].try_cast("int"), hour, minute, second)
    return F.try_to_timestamp(written, F.lit("yyyy-MM-dd HH:mm:ss"))


def _parse(text: Column, day_first: bool) -> Column:
    """One reading of a date text, null if it is none.

    Zones are accepted and times left as written: days are local days.
    """
    t = F.trim(text.cast("string"))
    layouts = [(YEAR_FIRST, "$1|$2|$3"), (NUMERIC, "$3|$2|$1" if day_first else "$3|$1|$2"),
               (COMPACT, "$1|$2|$3"), (DAY_NAME, "$3|$2|$1"), (NAME_DAY, "$3|$1|$2")]
    parts = F.coalesce(*[F.when(t.rlike(shape), F.split(F.regexp_replace(t, shape, order + "|$4|$5|$6|$7"), r"\|", -1))
                         for shape, order in layouts])
    # through a lambda, so that the parts are found once
    return F.transform(F.array(parts), _stamp)[0]


def parse_month_first(c: Column) -> Column:
    return _parse(c, day_first=False)


def parse_day_first(c: Column) -> Column:
    return _parse(c, day_first=True)


def best_coverage_timestamp(df: DataFrame, name: str) -> Column:
    """Month-first unless day-first parses strictly more rows of the column.

    Typed date/timestamp columns are returned unchanged (nothing to choose).
    """
    dtype = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c
    a, b = parse_month_first(c), parse_day_first(c)
    prefer_day_first = df.select((F.count(b) > F.count(a)).alias("day_first")).scalar()
    return F.when(prefer_day_first, b).otherwise(a)


DICTIONARY_ROWS = 1_000_000   # distinct date texts that are broadcast with their readings


def with_best_timestamp(df: DataFrame, name: str, out: str) -> DataFrame:
    """B8 by dictionary: ``df`` with column ``out``, the best-coverage reading of ``name``.

    A column holds few distinct texts next to its rows.  These are collected
    with a map-side combine, read once in both ways and landed with their
    counts, which settles the choice.  Up to DICTIONARY_ROWS of them are
    broadcast, and the rows only look their text up; with more, the rows read
    their text themselves, in the one chosen way.  Either way the frame scans
    its input once.
    """
    if _is_typed(df, name):
        return df.withColumn(out, F.col(f"`{name}`"))
    known = _land_texts(df, name, a=parse_month_first, b=parse_day_first)
    seen = known.agg(F.count(F.lit(1)).alias("texts"), F.sum(F.when(F.col("a").isNotNull(), F.col("n"))).alias("a"),
                     F.sum(F.when(F.col("b").isNotNull(), F.col("n"))).alias("b")).first()
    day_first = (seen["b"] or 0) > (seen["a"] or 0)
    if seen["texts"] > DICTIONARY_ROWS:
        return df.withColumn(out, _parse(F.col(f"`{name}`"), day_first))
    return _look_up(df, name, out, known, "b" if day_first else "a")


def with_month_first_timestamp(df: DataFrame, name: str, out: str) -> DataFrame:
    """Stock dates: ``df`` with column ``out``, the month-first reading of ``name`` (the reference does not
    try day-first), by dictionary as in ``with_best_timestamp``."""
    if _is_typed(df, name):
        return df.withColumn(out, F.col(f"`{name}`"))
    known = _land_texts(df, name, a=parse_month_first)
    if known.count() > DICTIONARY_ROWS:
        return df.withColumn(out, parse_month_first(F.col(f"`{name}`")))
    return _look_up(df, name, out, known, "a")


def _is_typed(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))


def _land_texts(df: DataFrame, name: str, **readings) -> DataFrame:
    """The distinct texts of a column with their counts ``n`` and their readings, landed."""
    spark = df.sparkSession
    texts = df.groupBy(F.col(f"`{name}`").cast("string").alias("_text")).agg(F.count(F.lit(1)).alias("n"))
    path = scratch_path(spark, "date-texts")
    (texts.where("_text is not null")
     .select("_text", "n", *[read(F.col("_text")).alias(k) for k, read in readings.items()]).write.parquet(path))
    return spark.read.parquet(path)


def _look_up(df: DataFrame, name: str, out: str, known: DataFrame, reading: str) -> DataFrame:
    found = known.select("_text", F.col(reading).alias("_read"))
    joined = df.join(F.broadcast(found), F.col(f"`{name}`").cast("string") == found["_text"], "left")
    return joined.select(*[df[f"`{c}`"] for c in df.columns if c != out], found["_read"].alias(out))


def to_day(c: Column) -> Column:
    """Truncate to the calendar day."""
    return F.to_date(c)


def month_bucket(c: Column) -> Column:
    """B17: 'YYYY-MM'."""
    return F.date_format(c, "yyyy-MM")


def in_range(c: Column, start: dt.date, end_exclusive: dt.date) -> Column:
    """Half-open date range; written as a range so it pushes down to the scan."""
    return (c >= F.lit(start)) & (c < F.lit(end_exclusive))


def in_months(month: Column, start: dt.date, end_exclusive: dt.date) -> Column:
    """Whether a 'YYYY-MM' month lies in a range whose ends are first days of months."""
    return (month >= F.lit(start.strftime("%Y-%m"))) & (month < F.lit(end_exclusive.strftime("%Y-%m")))
