import pytest

DOCS = "doc_id long, text string"
#: Columns whose names an operator might use itself.
CLASHING = "doc_id long, text string, n_words int, spans string, kind string, score string, _row int, _n int, _lead int, _id int, `a.b` int"


@pytest.fixture
def docs(spark):
    def make(*texts, start=0):
        return spark.createDataFrame([(i, t) for i, t in enumerate(texts, start)], DOCS)

    return make


@pytest.fixture
def clashing(spark):
    """The given texts beside columns with clashing names and nulls."""

    def make(*texts):
        rows = [(i, t, None, "x", None, "y", 3, 7, 8, 9, 10) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, CLASHING)

    return make
