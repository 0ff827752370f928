import pytest

from quireflow.session import session


@pytest.fixture(scope="session")
def spark():
    spark = session("local[4]", "tests", spark__sql__shuffle__partitions="4")
    spark.sparkContext.setLogLevel("OFF")
    return spark
