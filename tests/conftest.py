import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pixelhour.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("tests", "8", **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("work"))})
    yield session
    session.stop()


@pytest.fixture
def measure(spark):
    """Measurements from (id, device, payload dict or text, created_at text) rows."""
    def build(*rows):
        data = [(i, d, p if isinstance(p, str) else json.dumps(p), at, at) for i, d, p, at in rows]
        df = spark.createDataFrame(data, "id long, device_id long, payload string, created_at string, updated_at string")
        return df.selectExpr(
            "id", "device_id", "payload", "cast(created_at as timestamp_ntz) created_at",
            "cast(updated_at as timestamp_ntz) updated_at",
        )
    return build
