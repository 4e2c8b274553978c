import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from adlens.session import get_spark  # noqa: E402

FIXTURES = os.path.join(ROOT, "tests", "fixtures")
SMOKE_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[4]", app_name="adlens-tests", shuffle_partitions=8, conf={"spark.driver.memory": "6g"})
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="adlens-test-ckpt-"))
    yield s


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="adlens-test-")


@pytest.fixture(scope="session")
def demo_fact(spark):
    from adlens.operators.ingest import standardize_layout
    raw = spark.read.option("header", True).csv(os.path.join(FIXTURES, "demo_ads.csv"))
    fact, _ = standardize_layout(raw, "demo")
    return fact.cache()
