"""Small documents with all the awkward cases."""

import pytest

from tests.llm.cases import ODD


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing extra columns."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, id long, fp string, score string, spans int, _text string, line int, node long, _id int, _th int, _lang int, _g int, _w int, _cell int, _at int, _n int, _start int, _source int, _x0 int, _row int"
    return spark.createDataFrame(ODD, schema)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
