import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def texts(spark):
    """A function from a list of strings to (id, text)."""

    def make(values, **columns):
        rows = [(i, v, *[c[i] for c in columns.values()]) for i, v in enumerate(values)]
        kinds = {int: "int", float: "double", str: "string"}
        extra = "".join(f", {n} {kinds[type(c[0])]}" for n, c in columns.items())
        return spark.createDataFrame(rows, "id long, text string" + extra)

    return make
