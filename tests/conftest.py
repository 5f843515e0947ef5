import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from roundhouse.session import get_spark
    s = get_spark("local[*]", 8, app="roundhouse-tests")
    yield s


@pytest.fixture(scope="session")
def duck():
    from oracle_check import duck_connect
    con = duck_connect(SF_SMALL)
    yield con
    con.close()


def rows(df, *cols):
    """Collected rows as tuples of the given (or all) columns."""
    cols = cols or tuple(df.columns)
    return [tuple(r[c] for c in cols) for r in df.collect()]
