import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from lakerules.session import checkpoint_dir, get_spark
    s = get_spark("local[4]", 4)
    checkpoint_dir(s)
    yield s
    s.stop()
