import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from cadence.session import get_spark, ensure_checkpoint_dir
    s = get_spark("local[4]", 4)
    ensure_checkpoint_dir(s)
    yield s
    s.stop()
