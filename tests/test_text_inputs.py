"""UTF-16 exports with quoted line ends read by many tasks, date dictionaries, file order, odd numbers and months."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows, text_frame
from test_jobs import write
from test_plans import plan_text

from shelfgap.functions import cleaning as C
from shelfgap.functions import dates as D
from shelfgap.operators import quality as Q
from shelfgap.plans.jobs import with_file_order
from shelfgap.profiles import ChannelProfile
from shelfgap.sources import loaders as L
from shelfgap.sources import readers as RD
from shelfgap.sources.contracts import contract_for

HEADER = "Purchase Date\tSku\tstock\tQuantity\tGross\tNet\tProduct Name"


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(12 * 1024))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def export(n, seed, end="\n", long=0):
    pick = random.Random(seed)
    lines = [HEADER]
    for i in range(n):
        name = pick.choice(["กระเป๋า", "Bag 12\"", "a\tb", f"two{end}lines", f"\"q\"{end}{end}x, {end}", "", "plain"])
        if long and i % 50 == 0:
            name = end.join("long" * 20 for _ in range(long))     # over several splits
        quoted = '"' + name.replace('"', '""') + '"' if set(name) & set('\t"\n\r') else name
        lines.append(f"2026-02-{i % 28 + 1:02d}\tK{i}\tWH-BKK\t{i % 7}\t1,{i % 1000:03d}\t{i % 50}\t{quoted}")
    return end.join(lines) + end


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("encoding", ["utf-16-le", "utf-16-be"])
@pytest.mark.parametrize("long", [0, 300])
def test_quoted_line_ends_equal_the_single_task_reader(spark, tmp_path, small_splits, end, encoding, long):
    path = tmp_path / "o.tsv"
    write(path, "﻿" + export(600, 1, end, long), encoding=encoding)
    split = RD.read_orders_export(spark, str(path), quoted_newlines=True)
    assert split.columns[:-1] == HEADER.split("\t")
    one = RD.read_orders_export(spark, str(path), multiline=True)
    assert spark.read.option("lineSep", "\n").text(str(path)).rdd.getNumPartitions() > 4
    assert one.count() == 600
    assert rows(split.drop("row_ord").fillna("<null>")) == rows(one.fillna("<null>"))
    ordered = [r["Sku"] for r in split.orderBy("row_ord").collect()]
    assert ordered == [f"K{i}" for i in range(600)]


def test_quoted_line_ends_in_many_files(spark, tmp_path, small_splits):
    folder = tmp_path / "many"
    folder.mkdir()
    for i in (1, 2, 10):
        write(folder / f"part-{i}.tsv", export(40, i), encoding="utf-16-le")
    got = RD.read_orders_export(spark, str(folder), quoted_newlines=True)
    assert got.count() == 120
    files = [r["row_ord"]["file"] for r in got.orderBy("row_ord").collect()]
    assert files == sorted(files) and len(set(files)) == 3
    write(tmp_path / "empty.tsv", HEADER + "\n", encoding="utf-16-le")
    assert RD.read_orders_export(spark, str(tmp_path / "empty.tsv"), quoted_newlines=True).count() == 0


def test_no_record_is_gathered_that_stands_on_one_line(spark, tmp_path):
    path = tmp_path / "o.tsv"
    write(path, export(100, 1), encoding="utf-16-le")
    text = plan_text(RD.read_orders_export(spark, str(path), quoted_newlines=True))
    assert "SinglePartition" not in text and "Python" not in text


def moved_rows(df) -> int:
    """Rows written by the exchanges of a frame that is collected; one that is used again counts once."""
    df.collect()
    found = {}

    def visit(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "ShuffleExchangeExec":
            found[plan.id()] = plan.metrics().apply("shuffleRecordsWritten").value()
        if kind == "AdaptiveSparkPlanExec":
            visit(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            visit(plan.plan())
        for i in range(plan.children().size()):
            visit(plan.children().apply(i))

    visit(df._jdf.queryExecution().executedPlan())
    return sum(found.values())


def test_lines_are_moved_once_as_chunks(spark, tmp_path):
    """A row that is moved holds thousands of lines; only lines of records that cross chunks are moved again."""
    path = tmp_path / "o.tsv"
    write(path, HEADER + "\n" + "".join(f'd\tK{i}\ts\t1\t1\t1\t"two\nlines"\n' for i in range(15000)), encoding="utf-16-le")
    got = RD.read_orders_export(spark, str(path), quoted_newlines=True)
    assert moved_rows(got) < 500
    assert moved_rows(spark.range(1000).repartition(3)) == 1000
    assert got.count() == 15000


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_cross_chunks(spark, tmp_path, monkeypatch, end):
    monkeypatch.setattr(RD, "CHUNK_BITS", 2)
    marks = [RD.ESCAPE, RD.ESCAPE + "0", f"{RD.ESCAPE}1{end}0AF", f"000{end}{end}001"]
    lines, firsts, at = [], [], 1
    for i in range(200):
        name = marks[i % 4] + ("long" + end) * (i % 17)
        lines.append(f'2026-02-01\tK{i}\ts\t1\t1\t1\t"{name}"' + (end if i % 5 == 0 else ""))
        firsts.append((f"K{i}", at))
        at += (lines[-1] + end).count("\n")
    path = tmp_path / "o.tsv"
    write(path, "\ufeff" + end.join([HEADER, *lines]) + end, encoding="utf-16-le")
    got = RD.read_orders_export(spark, str(path), quoted_newlines=True)
    one = RD.read_orders_export(spark, str(path), multiline=True)
    assert one.count() == 200 and rows(got.drop("row_ord")) == rows(one)
    assert sorted((r["Sku"], r["line"]) for r in got.select("Sku", "row_ord.line").collect()) == sorted(firsts)


def test_written_export_is_compressed_utf16(spark, tmp_path, monkeypatch):
    from conftest import SF_SMALL
    from shelfgap.plans import catalog as CAT
    monkeypatch.setattr(CAT, "EXPORT_PART_LINES", 500)
    monkeypatch.setattr(CAT, "scratch_path", lambda spark, name: str(tmp_path / name))
    lines = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").count()
    assert CAT.QUERIES["orders_export_utf16"](spark, SF_SMALL).count() == lines
    parts = [p for p in (tmp_path / "orders-export").iterdir() if p.name.startswith("part-")]
    texts = [gzip.decompress(p.read_bytes()) for p in parts]
    assert len(parts) >= lines / 500 and sum(len(t) for t in texts) > 5 * sum(p.stat().st_size for p in parts)
    assert all(t.decode("utf-16-le").startswith(HEADER + "\n") for t in texts)
    assert sum(t.decode("utf-16-le").count('\n""second"" line\n') for t in texts) == lines


def test_records_carry_no_padded_file_name(spark, tmp_path):
    """The file's name is padded once a split, and not at all where no place is asked for."""
    path = tmp_path / "o.tsv"
    write(path, export(100, 1), encoding="utf-16-le")
    got = RD.read_orders_export(spark, str(path), quoted_newlines=True)
    assert "[0-9]+" not in plan_text(got.drop("row_ord"))
    want = spark.range(1).select(RD.natural_name(F.lit(str(path)))).first()[0]
    assert got.select("row_ord.file").first()[0].endswith(want) and "0" * 10 in want


def test_file_order_follows_numbered_parts_and_splits(spark, tmp_path, small_splits):
    folder = tmp_path / "parts"
    folder.mkdir()
    want = []
    for i in (1, 2, 9, 10, 11):
        n = 3000 if i == 2 else 5
        write(folder / f"part-{i}.csv", "a\n" + "".join(f"{i}-{k:05d}\n" for k in range(n)))
        want += [f"{i}-{k:05d}" for k in range(n)]
    df = with_file_order(RD.read_delimited(spark, str(folder)))
    assert df.rdd.getNumPartitions() > 1
    assert [r["a"] for r in df.orderBy("row_ord").collect()] == want


def test_natural_names(spark):
    names = ["f10/p2", "f9/p1", "f10/p10", "f9/p01x", "f9/p1x"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r["n"] for r in df.orderBy(RD.natural_name(F.col("n")), "n").collect()]
    assert got == ["f9/p1", "f9/p01x", "f9/p1x", "f10/p2", "f10/p10"]


# ---- dates --------------------------------------------------------------------
def test_dictionary_reads_as_the_column_reading(spark, monkeypatch):
    texts = ["01.02.2026", "25.12.2026", "2026-03-04", "", None, "x", "13/01/26"] * 30 + ["1.2.26"]
    df = text_frame(spark, ["d", "out"], [(t, "kept") for t in texts])
    want = rows(df.select(D.best_coverage_timestamp(df, "d").cast("string").alias("o"), F.coalesce("d", F.lit("<null>")).alias("d"))
                .fillna("<null>"))
    for most in (1_000_000, 2):
        monkeypatch.setattr(D, "DICTIONARY_ROWS", most)
        got = D.with_best_timestamp(df, "d", "o")
        assert got.columns == ["d", "out", "o"]
        assert rows(got.select(F.col("o").cast("string").alias("o"), F.coalesce("d", F.lit("<null>")).alias("d"))
                    .fillna("<null>")) == want


def test_orders_are_scanned_once_for_their_dates(spark, tmp_path):
    path = str(tmp_path / "orders")
    text_frame(spark, HEADER.split("\t"), [("25.12.2026", "K1", "s", "1", "2", "3", "n")] * 20).write.parquet(path)
    text = plan_text(L.load_orders(spark.read.parquet(path), "th"))
    assert text.count("Scan parquet") // 2 == 2 and text.count(f"{path}]") + text.count(f"{path},") == 1


def test_stock_dates_are_read_by_dictionary(spark, monkeypatch):
    texts = ["01.02.2026", "25.12.2026", "2026-03-04", "", None, "x", "5-Jan-2026"] * 3
    raw = text_frame(spark, ["posting_date", "site_code", "article_code", "stock_balance"],
                     [(t, "1", f"K{i}", i) for i, t in enumerate(texts)])
    days = ["2026-01-02", None, "2026-03-04", None, None, None, "2026-01-05"]    # 25.12. is no month first
    want = sorted((f"K{i}", days[i % 7]) for i in range(21) if days[i % 7])
    for most in (1_000_000, 2):
        monkeypatch.setattr(D, "DICTIONARY_ROWS", most)
        stock = L.load_daily_stock(raw)
        assert ("[-/.]" in plan_text(stock)) == (most == 2)      # the layouts of numeric dates
        assert rows(stock.select("sku", F.col("posting_date").cast("string").alias("d"))) == want


def test_best_coverage_query_reads_dates_by_dictionary(spark):
    from conftest import SF_SMALL
    from shelfgap.plans import catalog as CAT
    assert "[-/.]" not in plan_text(CAT.QUERIES["parse_dates_best"](spark, SF_SMALL))


@pytest.mark.parametrize("text,day", [("5 January 2026", "2026-01-05"), ("5-Jan-2026", "2026-01-05"),
                                      ("Sept 7, 2026", "2026-09-07"), ("5 Janvier 2026", None), ("5 Maya 2026", None)])
def test_month_names_are_whole_or_three_letters(spark, text, day):
    df = text_frame(spark, ["d"], [(text,)])
    got = df.select(F.to_date(D.parse_month_first(F.col("d"))).cast("string").alias("o")).first()["o"]
    assert got == day


# ---- numbers and layouts --------------------------------------------------------
def test_numbers_that_are_not_kept_are_found(spark):
    cases = {"1": False, "1,000.5": False, "": False, None: False, "nan": False, "0": False, "-0.00": False, "0e5": False,
             "1e3": False, "abc": True, "123456789012345678901234567890": True, "1e40": True, "0.12345678901": True,
             "0.12345678900": False, "10d": True}
    df = text_frame(spark, ["n"], [(t,) for t in cases])
    got = [r[0] for r in df.select(C.unread_number("n", df.schema["n"].dataType).alias("x")).collect()]
    assert got == list(cases.values())
    raw = text_frame(spark, HEADER.split("\t"), [("2026-02-01", "K1", "s", "1", "x", "1e40", "n"),
                                                ("2026-02-01", "K1", "s", "1", "y", "3", "n")])
    found = {r["message"] for r in Q.dataset_findings("sales", raw, "th").collect() if r["code"] == "unparsed_numbers"}
    assert found == {Q.MSG_NUMBERS.format(field="Gross") % 2, Q.MSG_NUMBERS.format(field="Net") % 1}


def test_loaders_follow_the_contract_of_a_profile_of_ones_own(spark):
    plain = ChannelProfile("own", "Own")
    orders = text_frame(spark, HEADER.split("\t"), [("2026-02-01", "K1", "s", "1", "2", "3", "n")])
    assert set(contract_for("sales", plain).required_columns) <= set(orders.columns)
    assert L.load_orders(orders, plain).count() == 1
    assert L.load_products(text_frame(spark, ["skuNo"], [("K1",)]), plain).count() == 1
    sheets = ChannelProfile("own2", "Own2", sheets={"sales": ("A",), "sku_live": ("P",)})
    sheet = text_frame(spark, ["SKU CODE", "WEB STATUS", "DESCRIPTION"], [("K1", "live", "n")])
    assert L.load_products({"P": sheet}, sheets).count() == 1
    with pytest.raises(ValueError, match="required columns"):
        L.load_orders(orders, sheets)


# ---- rejected lines -------------------------------------------------------------
def test_lines_that_are_no_records_are_set_aside(spark, tmp_path):
    path = tmp_path / "s.csv"
    body = ["a,b,c", '1,"x, ""y""",3', "2,short", "3,x,y,long", '4,"open,5', "", "6,,", "7,caf\xe9,1", '8,"a ""b, c",']
    path.write_bytes("\n".join(body).encode("latin-1") + b"\n")
    good, rejected = RD.land_checked(spark, str(path), str(tmp_path / "out"))
    assert good.columns == ["a", "b", "c", "row_ord"]
    assert sorted(r["a"] for r in good.collect()) == ["1", "6", "8"]
    assert [r["a"] for r in good.orderBy("row_ord").collect()] == ["1", "6", "8"]
    assert dict(rows(rejected, "a", "_state")) == {"2": "short", "3": "long", "4": "quoting", "7": "undecodable"}
    assert dict(rows(rejected.where("_line is not null"), "a", "_line")) == {
        "2": "2,short", "3": "3,x,y,long", "4": '4,"open,5'}
    codes = {r["code"]: r["message"] for r in Q.rejected_findings(rejected, "stock").collect()}
    assert codes["rejected_lines_short"] == "1 line(s) were set aside: short." and len(codes) == 4
    (tmp_path / "e.csv").write_text("a,b\n")
    good, rejected = RD.land_checked(spark, str(tmp_path / "e.csv"), str(tmp_path / "out2"))
    assert good.count() == rejected.count() == 0


def test_places_are_landed_with_written_names(spark, tmp_path):
    path = tmp_path / "s7.csv"
    path.write_text("a,b\n1,2\n3\n")
    good, rejected = RD.land_checked(spark, str(path), str(tmp_path / "out"))
    landed = spark.read.parquet(str(tmp_path / "out"))
    assert all(r[0].endswith(str(path)) for r in landed.select("_place.file").collect()) and landed.count() == 2
    want = spark.range(1).select(RD.natural_name(F.lit(str(path)))).first()[0]
    files = [r[0] for r in good.select("row_ord.file").union(rejected.select("_place.file")).collect()]
    assert len(files) == 2 and all(f.endswith(want) for f in files) and want != str(path)
    assert "[0-9]+" not in plan_text(good.drop("row_ord"))


# ---- plans ----------------------------------------------------------------------
def test_bucketed_stock_is_not_exchanged(spark, tmp_path):
    from conftest import SF_SMALL
    from shelfgap.operators import stock as K
    from shelfgap.plans import catalog as CAT
    from shelfgap.sources import adapter as A
    i, cfg = CAT.inputs(spark, SF_SMALL), A.test_config()
    stock = RD.land_by_sku(i.stock, str(tmp_path / "stock"), 4)
    i.site_map.write.parquet(str(tmp_path / "sites"))        # a dimension of known size, so it is what is broadcast
    site_map = spark.read.parquet(str(tmp_path / "sites"))
    got = K.stock_day_counts(K.day_balance(stock, site_map, cfg))
    text = plan_text(got)
    assert "hashpartitioning" not in text and "Bucketed: true" in text
    want = K.stock_day_counts(K.day_balance(i.stock, i.site_map, cfg))
    assert rows(got) == rows(want)


def test_the_grid_holds_a_channels_own_sites_only(spark):
    from shelfgap.operators import model as M
    skus = spark.createDataFrame([("a", "K1", "n"), ("b", "K2", "n"), ("none", "K3", "n")], "channel string, sku string, product_name string")
    site_map = spark.createDataFrame([("a", "1", "x"), ("a", "2", "x"), ("a", "3", "y"), ("b", "1", "z")],
                                     "channel string, site_code string, virtual_site string")
    got = M.site_grid(skus, site_map)
    assert got.columns == ["sku", "product_name", "channel", "virtual_site"]
    assert rows(got) == [("K1", "n", "a", "x"), ("K1", "n", "a", "y"), ("K2", "n", "b", "z")]
