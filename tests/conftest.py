from __future__ import annotations

import pytest

from placegrid.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g",
        "spark.sql.warehouse.dir": str(base / "warehouse"), "spark.checkpoint.dir": f"file://{base}/shared",
    }
    s = session("tests", "local[8]", **conf)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
