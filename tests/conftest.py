import pytest

from quillspark.plans.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session(master="local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.default.parallelism": "4"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
