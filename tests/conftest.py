import os
import sys

import pytest
from pyspark.sql import SparkSession, types as T

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__  # noqa: E402,F401  (registers the package for the Python workers)
from filestrata.session import tune  # noqa: E402

FILE_ROWS = T.StructType([
    T.StructField("project_id", T.StringType()), T.StructField("path", T.StringType()),
    T.StructField("mtime", T.TimestampNTZType()), T.StructField("raw_text", T.StringType()),
])


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("filestrata-tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield tune(session)
    session.stop()


@pytest.fixture(scope="session")
def make_files(spark):
    """A files table from {project: {path: text}}."""
    from filestrata.sources.tables import files_table

    def make(projects: dict):
        rows = [(project, path, None, text) for project, files in projects.items() for path, text in files.items()]
        return files_table(spark.createDataFrame(rows, FILE_ROWS))

    return make
