import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


SCHEMA = "repo string, path string, language string, text string"


@pytest.fixture(scope="session")
def make_files(spark):
    def build(*items):
        rows = [("r", path, "python" if path.endswith(".py") else "java", text)
                for path, text in items]
        return spark.createDataFrame(rows, SCHEMA)
    return build
