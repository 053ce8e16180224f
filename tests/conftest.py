import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

from tidemark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4, app="tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def shops(spark):
    """A small table with quoted texts, gaps, a text date and a category."""
    rows = [
        ("'North'", "'20/01/2023'", "'plain'", 50, 1000, 5, "'yes'"),
        ("'South'", "'07/04/2020'", "'fine'", 62, 1500, 7, "'yes'"),
        ("'East'", "'01/01/2023'", "'mixed'", 43, 1200, 6, "'no'"),
        ("'West'", "'01/01/2024'", "'other'", 45, 900, 4, "'no'"),
        ("'Port'", "'07/05/2024'", "'mixed'", 45, 1000, 4, None),
        ("'Mill'", "'18/04/2024'", "'mixed'", 50, 1050, 4, None),
        ("'Hill'", "'10/04/2024'", "'fine'", None, 1150, 4, "'yes'"),
    ]
    return spark.createDataFrame(
        rows, "shop string, opened string, class string, area int, sales int, tables int, special string"
    )


def rows(df, *order):
    """All rows as tuples, sorted by the named columns (or whole)."""
    if order:
        df = df.orderBy(*order)
        return [tuple(r) for r in df.collect()]
    return sorted((tuple(r) for r in df.collect()), key=repr)
