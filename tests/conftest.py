import pytest
from pyspark.sql import SparkSession

from plumbline.functions.scratch import clear


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shared")
    s = SparkSession.builder.master("local[4]").config("spark.checkpoint.dir", f"file://{folder}").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    clear(s)
