import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from helpers import LOT_DEPTH, LOT_WIDTH, lot_corner, rectangle  # noqa: E402
from rooftally.workspace import ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
               .config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
               .config("spark.ui.showConsoleProgress", "false").config("spark.sql.maxMetadataStringLength", "5000")
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def lots(spark):
    """Twenty-four equal lots; every third comes from the second source."""
    rows = [(i, [[rectangle(*lot_corner(i), LOT_WIDTH, LOT_DEPTH)]], "microsoft" if i % 3 == 2 else "google", 0.5 + i / 64)
            for i in range(24)]
    return spark.createDataFrame(rows, "id int, geometry array<array<array<array<double>>>>, bf_source string, "
                                       "confidence double")
