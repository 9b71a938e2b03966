import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Rows and a schema to a DataFrame of two partitions."""
    return lambda rows, schema: spark.createDataFrame(rows, schema).repartition(2)
