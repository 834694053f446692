import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from netloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(2, 2, memory="3g")
    yield s
    s.stop()
