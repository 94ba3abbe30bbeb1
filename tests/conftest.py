import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from biblioweave.session import local_session, release_scratch  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=4, memory="4g")
    yield session
    release_scratch(session)
    session.stop()


@pytest.fixture
def value(spark):
    """Evaluate a column expression over one row of text columns."""

    def run(make, **columns):
        names = ", ".join(f"{name} string" for name in columns) or "x string"
        row = tuple(columns.values()) or (None,)
        df = spark.createDataFrame([row], names)
        result = df.select(make(*[df[c] for c in df.columns]).alias("v")).collect()[0]["v"]
        return result.asDict(recursive=True) if hasattr(result, "asDict") else result

    return run
