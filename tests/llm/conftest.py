import pytest


@pytest.fixture
def frame(spark):
    """Rows as a DataFrame, in several partitions."""
    return lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
