import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from helixframe.session import get_spark

    session = get_spark("tests", cores=4, shuffle_partitions=4, **{"spark__checkpoint__dir": str(tmp_path_factory.mktemp("checkpoint"))})
    yield session
    session.stop()


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())
