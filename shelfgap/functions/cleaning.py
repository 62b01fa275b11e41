"""Column -> Column cleaning expressions.

All are built-in Spark expressions, so they stay inside whole-stage codegen.
Python's ``str.strip`` removes any Unicode whitespace while Spark's ``trim``
removes spaces only, hence ``strip`` below uses a Unicode-aware regex.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: the characters Python's str.strip() treats as whitespace --
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003"
                 "\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
# the same set as a Java regex character class
_WS = ("[\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029"
       "\\u202F\\u205F\\u3000]")
# ---------------------------------------------------------------------------


_PLAIN_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"
_SCIENTIFIC_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)[eE][+-]?[0-9]{1,3}$"


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _has_any(s: Column, chars: str) -> Column:
    """True when ``s`` contains one of ``chars`` (a translate, no regex)."""
    return F.length(F.translate(s, chars, "")) != F.length(s)


def strip(c: Column | str) -> Column:
    """Remove leading and trailing whitespace (any Unicode space, tab, newline).

    Values without any whitespace skip the regex (the common case).
    """
    s = col_(c)
    return F.when(_has_any(s, PY_WHITESPACE), F.regexp_replace(s, f"^{_WS}+|{_WS}+$", "")
                  ).otherwise(s)


def as_text(c: Column | str) -> Column:
    return col_(c).cast("string")


def clean_id(c: Column | str, dtype: T.DataType | None = None) -> Column:
    """B1: strip, drop quotes and '=', drop one trailing '.0', drop inner whitespace.

    A double id is written out in full first (``dtype``): 1.0E7 is the id 10000000.

    The '.0' test runs before whitespace removal, as in the reference.
    Nulls stay null (deliberate deviation: the reference turns them into 'nan').
    """
    raw = as_text(c)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        whole = col_(c).try_cast("decimal(38,0)")
        raw = F.when(whole.cast("double") == col_(c).cast("double"), whole.cast("string")).otherwise(raw)
    s = strip(raw)
    s = F.translate(s, "\"'=", "")
    # '$' as in Python: end of text or before one final '\n' only (UNIX_LINES)
    s = F.regexp_replace(s, "(?d)\\.0$", "")
    slow = F.regexp_replace(s, f"{_WS}+", "")
    # fast path: nothing to strip, drop or remove -> the value itself
    dirty = _has_any(raw, PY_WHITESPACE + "\"'=") | raw.endswith(".0")
    return F.when(dirty, slow).otherwise(raw)


def clean_site(c: Column | str) -> Column:
    """B2: strip, lower, remove whitespace."""
    return F.regexp_replace(F.lower(strip(as_text(c))), f"{_WS}+", "")


def is_excluded_sku(sku: Column | str) -> Column:
    """SKU whose lower-cased code starts with 'p' is excluded."""
    return F.coalesce(F.lower(col_(sku)).startswith("p"), F.lit(False))


def normalize_virtual_site(c: Column | str) -> Column:
    """Blank -> '', strip, lower."""
    return F.lower(strip(F.coalesce(as_text(c), F.lit(""))))


def normalize_stock_code(c: Column | str, replace: dict[str, str]) -> Column:
    """Lower, strip, then exact-value replacement."""
    s = strip(F.lower(as_text(c)))
    out = s
    for src, dst in replace.items():
        out = F.when(s == F.lit(src), F.lit(dst)).otherwise(out)
    return out


def parse_number(c: Column | str, dtype: T.DataType, strip_commas: bool = True) -> Column:
    """Text number -> DECIMAL(38,10), unparsable -> 0.

    Text is a number only in the shapes people write (sign, digits, point,
    exponent): Java's ``10d`` or ``0x1p3`` are not.  Decimals keep later sums
    exact whatever the partitioning; values beyond their range become 0.
    Typed numeric inputs keep their type; only nulls (and NaN) become 0.
    """
    c = col_(c)
    if isinstance(dtype, T.DecimalType) or isinstance(dtype, (T.IntegerType, T.LongType,
                                                              T.ShortType, T.ByteType)):
        return F.coalesce(c, F.lit(0).cast(dtype))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))
    text = as_text(c)
    if strip_commas:
        text = F.replace(text, F.lit(","), F.lit(""))
    text = strip(text)
    plain, scientific = text.rlike(_PLAIN_NUMBER), text.rlike(_SCIENTIFIC_NUMBER)
    exact = T.DecimalType(38, 10)
    value = F.when(plain, text.try_cast(exact)).when(scientific, text.try_cast("double").try_cast(exact))
    return F.coalesce(value, F.lit(0).cast(exact))


def unread_number(c: Column | str, dtype: T.DataType, strip_commas: bool = True) -> Column:
    """Whether a text is written but no number that ``parse_number`` keeps whole.

    So is a text of other shape, a value beyond DECIMAL(38,10) and digits after the tenth decimal.
    Typed columns have none.
    """
    if not isinstance(dtype, T.StringType):
        return F.lit(False)
    text = strip(F.replace(as_text(c), F.lit(","), F.lit("")) if strip_commas else as_text(c))
    value = parse_number(text, dtype, strip_commas=False)
    plain = text.rlike(_PLAIN_NUMBER)
    zero = text.rlike(r"^[+-]?0*(?:\.0*)?(?:[eE][+-]?[0-9]+)?$") & text.rlike("[0-9]")
    cut = plain & text.rlike(r"\.[0-9]{10}0*[1-9]")
    lost = ~(plain | text.rlike(_SCIENTIFIC_NUMBER)) | cut | ((value == 0) & ~zero)
    return F.coalesce((text != "") & (F.lower(text) != "nan") & lost, F.lit(False))


def active_flag(c: Column | str) -> Column:
    """upper(strip(coalesce(c, '')))."""
    return F.upper(strip(F.coalesce(as_text(c), F.lit(""))))


def normalize_status(c: Column | str) -> Column:
    """clean_id then lower."""
    return F.lower(clean_id(c))


def status_rank(status: Column | str) -> Column:
    """live = 2, hide = 1, anything else 0."""
    s = col_(status)
    return F.when(s == "live", 2).when(s == "hide", 1).otherwise(0)


def nonblank_flag(c: Column | str) -> Column:
    """1 when the trimmed text is non-empty, else 0."""
    return F.when(strip(F.coalesce(as_text(c), F.lit(""))) != "", 1).otherwise(0)


def safe_div(x: Column, y: Column) -> Column:
    """X / y when y > 0 else 0.0 (guarded, so ANSI mode never divides by zero)."""
    return F.when(y > 0, x / y).otherwise(F.lit(0.0))


def clip0(c: Column) -> Column:
    """max(c, 0)."""
    return F.greatest(c, F.lit(0))


def blank_to_empty(c: Column | str) -> Column:
    """strip(coalesce(c, ''))."""
    return strip(F.coalesce(as_text(c), F.lit("")))
