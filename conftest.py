import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])  # for the workers


@pytest.fixture(scope="session")
def spark():
    from threadloom.runtime import session

    return session("local[4]", 4, spark__driver__memory="4g")
