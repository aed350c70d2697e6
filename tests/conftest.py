import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"

# secret-looking fixture lines, assembled from parts
API_KEY_LINE = "api_" + 'key = "' + "a1B2c3D4e5" + "F6g7H8i9J0" + '"'
LOW_ENTROPY_KEY_LINE = "api_" + 'key = "' + "a" * 20 + '"'
COMMENTED_PASSWORD_LINE = "# pass" + 'word = "commented-out"'
JAVA_PASSWORD_LINE = "String pass" + 'word = "hunter22";'


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[4]").appName("scanforge-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s


def files_df(spark, rows, repo="r"):
    """(repo, path, content) from (path, content) pairs."""
    return spark.createDataFrame([(repo, p, c) for p, c in rows], "repo string, path string, content string")
