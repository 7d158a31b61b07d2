import os
import sys
from pathlib import Path

HERE = Path(__file__).resolve().parent
for p in (str(HERE), str(HERE.parent)):
    if p not in sys.path:
        sys.path.insert(0, p)
os.environ["PYTHONPATH"] = os.pathsep.join([str(HERE.parent), os.environ.get("PYTHONPATH", "")])

import pytest

from plumbline.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(8)
