import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from shelfgap.session import build_session
    s = build_session("local[4]", app_name="shelfgap-tests", shuffle_partitions=4,
                      driver_memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s


def rows(df, *cols):
    """Sorted list of tuples for the given columns (all when none given)."""
    cols = cols or tuple(df.columns)
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def text_frame(spark, columns, data):
    """A raw frame as read from a delimited file: every column a string."""
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in columns])
    return spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in data],
                                 schema)
