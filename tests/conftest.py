import json
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from snaplake.session import build_session, remove_work  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "snaplake-tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    remove_work(session)


@pytest.fixture
def land(tmp_path):
    """Writes a payload as a landing file of a table and returns the landing root."""

    def write(table, payload, day="2026-09-20", name="a"):
        folder = tmp_path / "landing" / table.prefix / day
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{name}.json").write_text(json.dumps(payload, indent=1))
        return str(tmp_path / "landing")

    return write
