import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from hapforge.session import build_session


@pytest.fixture(scope="session")
def spark():
    return build_session("tests", 4)
