import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from maskwright.session import local_session

    return local_session("tests", cpus=4, partitions=4)


@pytest.fixture(scope="session")
def sf():
    return SF
