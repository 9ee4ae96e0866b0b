import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from radiolake.session import local_session

    s = local_session(8, shuffle_partitions=8, app="tests")
    s.sparkContext.setLogLevel("ERROR")
    return s
