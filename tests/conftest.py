import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from plumbline.session import build_session

    session = build_session("tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_cells(spark):
    """Cells of one table from a header and rows of texts."""
    from plumbline.schemas import CELLS

    def make(header, rows, table="t", package="p"):
        data = [
            (package, table, f"{table}.csv", None, r + 1, c, header[c], value)
            for r, row in enumerate(rows)
            for c, value in enumerate(row)
        ]
        return spark.createDataFrame(data, CELLS)

    return make
