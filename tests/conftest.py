import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from vellum.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return session("local[4]", 4, spark__driver__memory="4g", spark__sql__warehouse__dir="/tmp/vellum-warehouse")
