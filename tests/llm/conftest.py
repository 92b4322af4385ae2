import pytest


@pytest.fixture
def docs(spark):
    def make(rows, extra=""):
        schema = "doc_id long, text string" + extra
        return spark.createDataFrame(rows, schema)

    return make
