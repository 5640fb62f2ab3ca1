import tempfile

import pytest
from pyspark.sql import SparkSession

from vellumspark.session import configured



@pytest.fixture(scope="session")
def spark():
    builder = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "3").config("spark.ui.enabled", "false").config("spark.driver.memory", "3g")
    session = configured(builder.config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp())).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
