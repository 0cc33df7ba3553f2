import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.path.dirname(os.path.dirname(os.path.abspath(__file__))) + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from sextant.session import build_session

    return build_session("tests", cpus=4, **{"spark.driver.memory": "4g"})


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
