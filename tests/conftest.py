import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from casewright.schemas import EVENT  # noqa: E402
from casewright.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("8", shuffle_partitions=4)


@pytest.fixture(scope="session")
def make_events(spark):
    """Canonical events from dictionaries; the rest of the schema is null."""

    def make(rows, **extra):
        from pyspark.sql import functions as F

        base = {
            "source": "sysmon", "platform": "windows", "category": "process", "event_type": "process_creation",
            "severity": 50, "source_reliability": "fairly_reliable",
        }
        lines = [(json.dumps({**base, **row}),) for row in rows]
        frame = spark.createDataFrame(lines, "raw string").select(F.from_json("raw", EVENT).alias("e")).select("e.*")
        return frame.withColumns({k: F.lit(v) for k, v in extra.items()})

    return make
