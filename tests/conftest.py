import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from assentlake.session import local_session  # noqa: E402
from assentlake.sources.lexicon import Matcher  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "tests")


@pytest.fixture(scope="session")
def matcher(spark):
    return Matcher.shipped(spark)


@pytest.fixture
def messages(spark):
    """Build a messages table from partial rows."""
    from datetime import datetime

    def build(*rows):
        base = {
            "harness": "claude",
            "session_id": "s1",
            "ts": datetime(2026, 1, 2),
            "model": "claude-opus-5",
            "text": "你说得对，我改。",
        }
        full = [{**base, "msg_id": str(i), **row} for i, row in enumerate(rows)]
        return spark.createDataFrame(
            [tuple(r[c] for c in ("msg_id", "harness", "session_id", "ts", "model", "text")) for r in full],
            "msg_id string, harness string, session_id string, ts timestamp, model string, text string",
        )

    return build
