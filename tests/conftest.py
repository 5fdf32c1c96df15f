import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from textlake.session import ensure_checkpoint_dir, local_session, ship_package

    s = local_session(cores=4, shuffle_partitions=8)
    ship_package(s)
    ensure_checkpoint_dir(s)
    yield s
