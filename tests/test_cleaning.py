import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfgap.functions import cleaning as C
from conftest import rows, text_frame


def one(spark, expr, value, dtype="string"):
    df = spark.createDataFrame([(value,)], f"v {dtype}")
    return df.select(expr(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize("raw,expected", [
    ('="SKU-1.0" ', "SKU-1"),        # export quoting, trailing .0, trailing space
    ("  1110.0\t", "1110"),           # Python strip also removes tabs
    ("1 .0", "1"),                    # '.0' tested before inner whitespace removal
    ("1. 0", "1.0"),                  # ... so this one keeps its '.0'
    ("A B C", "ABC"),            # inner (Unicode) whitespace removed
    ("'K1'", "K1"),
    ("K1.00", "K1.00"),               # only one trailing '.0' pattern
    ("K1", "K1"),                     # clean values pass through the fast path
    ("", ""),
    (None, None),                     # nulls stay null (deliberate deviation)
])
def test_clean_id(spark, raw, expected):
    assert one(spark, C.clean_id, raw) == expected


def test_clean_id_numeric_input(spark):
    assert one(spark, C.clean_id, 1110.0, "double") == "1110"


@pytest.mark.parametrize("raw,strip_commas,expected", [
    ("1,234.5", True, 1234.5),
    ("1,234.5", False, 0.0),          # B7 does not remove commas
    ("nan", True, 0.0),
    ("abc", True, 0.0),
    (None, True, 0.0),
    (" 12 ", True, 12.0),
])
def test_parse_number_text(spark, raw, strip_commas, expected):
    df = spark.createDataFrame([(raw,)], "v string")
    out = df.select(C.parse_number("v", T.StringType(), strip_commas).alias("o")).first()["o"]
    assert out == expected


def test_parse_number_keeps_decimals(spark):
    df = spark.createDataFrame([(None,)], "v decimal(18,2)")
    out = df.select(C.parse_number("v", df.schema["v"].dataType).alias("o"))
    assert out.schema["o"].dataType == T.DecimalType(18, 2)
    assert float(out.first()["o"]) == 0.0


def test_status_and_flags(spark):
    df = text_frame(spark, ["s", "name", "active", "vs"],
                    [(" Live ", " ", " x ", " WH-BKK "), ("HIDE", "Bag", "X", None),
                     ("other", None, "", "BKK-OUT")])
    out = df.select(C.normalize_status("s").alias("st"),
                    C.status_rank(C.normalize_status("s")).alias("r"),
                    C.nonblank_flag("name").alias("n"),
                    C.active_flag("active").alias("a"),
                    C.normalize_virtual_site("vs").alias("v")).collect()
    assert [tuple(r) for r in out] == [("live", 2, 0, "X", "wh-bkk"),
                                       ("hide", 1, 1, "X", ""),
                                       ("other", 0, 0, "", "bkk-out")]


def test_excluded_prefix_and_stock_code(spark):
    df = text_frame(spark, ["sku", "stock"], [("p123", " WH-BKK-2 "), ("K1", "Bkk-Out")])
    out = df.select(C.is_excluded_sku("sku").alias("x"),
                    C.normalize_stock_code("stock", {"wh-bkk-2": "wh-bkk"}).alias("s")).collect()
    assert [tuple(r) for r in out] == [(True, "wh-bkk"), (False, "bkk-out")]


def test_safe_div_and_clip(spark):
    df = spark.createDataFrame([(6.0, 3.0), (1.0, 0.0), (1.0, -2.0)], "x double, y double")
    out = df.select(C.safe_div(F.col("x"), F.col("y")).alias("d"),
                    C.clip0(F.col("x") - F.lit(2.0)).alias("c")).collect()
    assert [tuple(r) for r in out] == [(2.0, 4.0), (0.0, 0.0), (0.0, 0.0)]


def test_channel_keys(spark):
    import pytest as _pt
    from shelfgap.profiles import channel_key, export_code, get_profile, resolve_channels, split_by_channel
    assert channel_key(" King-Power CN ") == "kingpowercn"
    assert resolve_channels("th, KPCN,tht,th") == ["th", "kingpowercn", "tht"]
    assert export_code(get_profile("cn")) == "CN" and export_code(get_profile("tht")) == "THT"
    with _pt.raises(ValueError, match="no channel goes by"):
        channel_key("xx")
    df = text_frame(spark, ["c"], [(" K P/CN ",), ("Th",), ("other",), (None,)])
    known, rejected = split_by_channel(df, "c")
    assert rows(known) == [(" K P/CN ", "kingpowercn"), ("Th", "th")]
    assert {r["c"] for r in rejected.collect()} == {"other", None}


def test_double_ids_and_number_shapes(spark):
    df = spark.createDataFrame([(10000000.0,), (12345678.0,), (3.0,), (2.5,), (None,)], "x double")
    got = [r[0] for r in df.select(C.clean_id("x", T.DoubleType())).collect()]
    assert got == ["10000000", "12345678", "3", "2.5", None]
    text = ["10d", "0x1p3", "1,234.5", " 7 ", "1e3", "-.5", "NaN", "inf", "5.", "", None, "1_0", "1e400"]
    df = text_frame(spark, ["x"], [(v,) for v in text])
    got = [float(r[0]) for r in df.select(C.parse_number("x", T.StringType())).collect()]
    assert got == [0, 0, 1234.5, 7, 1000, -0.5, 0, 0, 5, 0, 0, 0, 0]
