import pytest

from tickforge.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    root = tmp_path_factory.mktemp("spark")
    s = session(
        "local[4]", 4,
        **{"spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": str(root / "shared"), "spark.sql.warehouse.dir": str(root / "warehouse")},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
