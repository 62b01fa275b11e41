
import pytest
from pyspark.sql import functions as F

from shelfgap.operators import model as M
from shelfgap.operators import reports as R
from shelfgap.plans import catalog as CAT
from shelfgap.sources import adapter as A
from conftest import SF_SMALL


@pytest.fixture(scope="module")
def detail(spark):
    i = CAT.inputs(spark, SF_SMALL)
    sites = M.site_names(i.site_map)
    d = M.loss_detail(i, A.test_config()).drop("channel").cache()
    return d, sites, M.universe(i.product, A.test_config()).count()


def test_grid_size(detail):
    d, sites, n_skus = detail
    assert d.count() == n_skus * len(sites)
    assert d.select("sku", "virtual_site").distinct().count() == d.count()


def test_day_bounds(detail):
    d, _, _ = detail
    bad = d.filter((F.col("oos_days_jan") < 0) | (F.col("oos_days_jan") > F.col("observed_days_jan"))
                   | (F.col("in_stock_days") > F.col("recorded_days"))
                   | (F.col("recorded_days") > F.col("observed_days_jan")))
    assert bad.count() == 0


def test_no_loss_when_sold(detail):
    d, _, _ = detail
    assert d.filter((F.col("actual_qty_jan") > 0) & (F.col("lost_qty_raw") != 0)).count() == 0


def test_sums_agree(detail):
    d, sites, _ = detail
    total = dict((r["metric"], r["value"]) for r in R.summary_total(d).collect())
    site = R.summary_site(d).agg(F.sum("lost_value_net_raw")).first()[0]
    sku = R.summary_sku(d, sites).agg(F.sum("lost_value_net_raw")).first()[0]
    assert site == pytest.approx(total["Total Lost Value Net Raw"])
    assert sku == pytest.approx(total["Total Lost Value Net Raw"])
