import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from evalloom.session import reachable, session

    s = session("local[4]", shuffle_partitions=4, spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")), spark__driver__memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield reachable(s)
    s.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
