import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tidebars import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    built = session.build(
        "tests", spark_master="local[4]", spark_sql_shuffle_partitions="4", spark_ui_enabled="false", spark_driver_memory="4g", spark_ui_showConsoleProgress="false"
    )
    built.sparkContext.setLogLevel("ERROR")
    yield session.ship(built)
    built.stop()
