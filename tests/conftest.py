from __future__ import annotations

import os
import tempfile

import pytest
from pyspark.sql import SparkSession

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    session = (SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
               .config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", shared).config("spark.sql.warehouse.dir", f"{shared}/warehouse").config("spark.checkpoint.dir", f"file://{shared}/checkpoints").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL
