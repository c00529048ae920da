import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from varietylens.session import build_session, ensure_checkpoint_dir
    s = build_session("local[4]", app="varietylens-tests", shuffle_partitions=4)
    ensure_checkpoint_dir(s)
    yield s
