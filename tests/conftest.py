import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from codeloom.session import get_session

    session = get_session("local[4]", "tests", 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
