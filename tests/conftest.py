import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    from trackyard.session import DEFAULT_CONF, ensure_checkpoint_dir
    b = SparkSession.builder.master("local[*]").appName("trackyard-tests")
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="trackyard-test-ckpt-"))
    ensure_checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def seed(spark):
    import datetime as dt
    from trackyard.sources.fixtures import Seed
    return Seed(spark, dt.date(2026, 3, 1))


SF_SMALL = "/root/testdata/sf0.001"
