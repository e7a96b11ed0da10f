import pytest


@pytest.fixture
def docs(spark):
    def make(rows, extra=False):
        if extra:
            return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, digest string, row_no int, source string")
        return spark.createDataFrame(rows, "doc_id long, text string")

    return make
