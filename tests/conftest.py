import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pricelens.config import build_session, ensure_checkpoint_dir
    s = build_session("local[4]", app_name="pricelens-tests", shuffle_partitions=4,
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="pricelens-test-ckpt-")})
    ensure_checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def model(spark):
    from pricelens.sources.tables import ModelTables
    return ModelTables(spark, SF)
