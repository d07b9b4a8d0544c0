import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark():
    from plumbline.session import local_session

    session = local_session("tests", 4, spark__sql__shuffle__partitions="4")
    session.sparkContext.setLogLevel("ERROR")
    return session
