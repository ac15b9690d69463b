import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))
os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 6g --conf spark.ui.enabled=false pyspark-shell")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from evalspark.session import build_session
    session = build_session("tests", "local[4]", 4, str(tmp_path_factory.mktemp("checkpoints")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
