import os

import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    builder = SparkSession.builder.master(f"local[{min(8, os.cpu_count() or 1)}]").appName("tests")
    settings = {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g", "spark.sql.session.timeZone": "UTC",
        "spark.sql.warehouse.dir": str(folder / "warehouse"), "spark.checkpoint.dir": str(folder / "checkpoints"), "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
