import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from fieldrecon.session import local_session

    return local_session("4", shuffle_partitions=4)


@pytest.fixture(scope="session")
def sf():
    return SF
