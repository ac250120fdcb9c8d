from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]
os.environ["PYTHONPATH"] = f"{ROOT}:{ROOT}/tests:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from plantweave.session import session, ship

    s = session(4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    ship(s)
    return s


SF = "/root/testdata/sf0.001"
