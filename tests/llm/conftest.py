import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest_llm import ALERT  # noqa: E402


@pytest.fixture(scope="session")
def alerts_of(spark):
    """Alerts of (alert_id, alert_type, layout_name), with columns whose names clash with working columns."""

    def make(rows):
        return spark.createDataFrame([(*r, "x", 7, 0.5, 8, 9) for r in rows], ALERT).repartition(3)

    return make
