import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from ticketlens.session import checkpoint_dir, get_spark
    s = get_spark("ticketlens-tests", cores=4, shuffle_partitions=4)
    checkpoint_dir(s)
    yield s


@pytest.fixture
def tmp_out(tmp_path):
    return str(tmp_path)
