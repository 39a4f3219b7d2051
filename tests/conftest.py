import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """``frame("a string, b double", [(...), ...])``"""

    def make(schema, rows):
        return spark.createDataFrame(rows, schema)

    return make


def rows(df, *order):
    """Collected rows as tuples, sorted for comparison."""
    chosen = df.select(*[f"`{c}`" for c in order]) if order else df
    out = [tuple(r) for r in chosen.collect()]
    return sorted(out, key=lambda r: tuple((x is not None, str(type(x)), x or 0) for x in r))
