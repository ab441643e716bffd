import pytest

PAGE = "fetch_id bigint, url string, site string, markdown string, error string, body string, line_no int"


@pytest.fixture
def pages(spark):
    """Pages from (fetch_id, site, markdown); further columns have names that the operators use."""

    def make(rows):
        return spark.createDataFrame([(i, f"https://www.{s or 'none.example'}/{i}", s, m, None, "x", 7) for i, s, m in rows], PAGE)

    return make
