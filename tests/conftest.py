import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark():
    from tallyspark.session import session

    s = session("local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
