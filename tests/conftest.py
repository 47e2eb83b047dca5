import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from oracle import session

    from ledgerlens.session import configure

    s = configure(session())
    yield s
    s.stop()


def rows(df, *order):
    """Collected rows as tuples, sorted."""
    return sorted([tuple(r) for r in df.collect()], key=lambda r: tuple((x is None, str(x)) for x in r))
