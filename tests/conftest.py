import os
import sys
from pathlib import Path

import pytest

HOME = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, HOME)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from brightloom.session import local

    session = local(4, **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")), "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")), "spark.driver.memory": "4g"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
