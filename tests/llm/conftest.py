import pytest


@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    """The operators run many small jobs here; three partitions show what eight would."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
