import datetime as dt

from pyspark.sql import functions as F

from shelfgap.functions.dates import best_coverage_timestamp
from shelfgap.profiles import ModelConfig, add_months
from conftest import text_frame


def parsed(spark, values):
    df = text_frame(spark, ["d"], [(v,) for v in values])
    return [r["o"] for r in df.select(F.to_date(best_coverage_timestamp(df, "d")).alias("o"))
            .collect()]


def test_best_coverage_day_first(spark):
    # '15.02.2026' cannot be month-first, so the day-first reading parses more rows
    assert parsed(spark, ["01.02.2026", "15.02.2026"]) == [dt.date(2026, 2, 1),
                                                          dt.date(2026, 2, 15)]


def test_best_coverage_tie_is_month_first(spark):
    # all days <= 12: both readings parse everything -> month-first is kept
    assert parsed(spark, ["01.02.2026", "03.04.2026"]) == [dt.date(2026, 1, 2),
                                                          dt.date(2026, 3, 4)]


def test_iso_and_junk(spark):
    assert parsed(spark, ["2026-02-01", "2026-02-28 10:11:12", "junk", None]) == [
        dt.date(2026, 2, 1), dt.date(2026, 2, 28), None, None]


def test_window_bounds_jan_2026():
    cfg = ModelConfig(eval_year=2026, eval_month=1)
    assert cfg.eval_days == 31
    assert (cfg.recent_start, cfg.recent_end) == (dt.date(2025, 7, 1), dt.date(2025, 12, 31))
    assert (cfg.fallback_start, cfg.fallback_end) == (dt.date(2025, 1, 1), dt.date(2025, 6, 30))
    assert (cfg.recent_days, cfg.fallback_days) == (184, 181)
    assert cfg.method_label == "rolling_6m_with_6m_fallback"


def test_window_bounds_feb_2026():
    cfg = ModelConfig(eval_year=2026, eval_month=2)
    assert cfg.eval_days == 28
    assert (cfg.recent_days, cfg.fallback_days) == (184, 181)
    assert add_months(dt.date(2024, 3, 31), -1) == dt.date(2024, 2, 29)


def test_layouts_that_people_write(spark):
    day = dt.date(2026, 1, 5)
    texts = ["2026-01-05 00:00:00.000", "2026-01-05T10:11:12Z", "2026-01-05T10:11:12.5+07:00", "5-Jan-2026",
             "05 January 2026", "Jan 5, 2026", "1/5/2026 11:59 PM", "1/5/26", "20260105", " 2026/1/5 ",
             "1/5/2026 12:00:00 AM"]
    assert parsed(spark, texts) == [day] * len(texts)
    # readings are judged over the column, so impossible dates stay out one by one
    assert parsed(spark, ["2026-02-30", "2026-13-01", "1/5/2026 25:00", "1/5/2026 13:00 PM", "5-Foo-2026", ""]) == [None] * 6


def test_ties_of_shapes_follow_the_column(spark):
    assert parsed(spark, ["5/1/26", "25/1/26"]) == [dt.date(2026, 1, 5), dt.date(2026, 1, 25)]
