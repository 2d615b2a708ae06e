from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from sirenlens.session import local_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return ship_package(local_session("8", "sirenlens-tests"))
