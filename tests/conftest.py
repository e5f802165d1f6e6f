import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from basketry.session import get_spark
    s = get_spark("local[4]", 4, conf={"spark.driver.memory": "12g"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small_tables(spark):
    from basketry.sources.fixtures import RetailTables
    return RetailTables(spark, SMALL)
