import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from sproutscope.session import tune

    return tune(session)


@pytest.fixture
def ts():
    """Parse ``YYYY-mm-dd[ HH:MM:SS]`` as UTC."""
    from datetime import datetime, timezone

    def parse(text):
        form = "%Y-%m-%d %H:%M:%S" if " " in text else "%Y-%m-%d"
        return datetime.strptime(text, form).replace(tzinfo=timezone.utc)

    return parse
