import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from marquee.session import build_session
    os.environ.setdefault("MARQUEE_SCRATCH", tempfile.mkdtemp(prefix="marquee-tests-"))
    s = build_session(master="local[*]", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def seed(spark):
    from marquee.sources.tables import seed_frames
    return seed_frames(spark)


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="marquee-t-", dir=os.environ.get("MARQUEE_SCRATCH", "/tmp"))


def rows(df, *cols):
    if not cols:
        return [tuple(r) for r in df.collect()]
    return [tuple(r[c] for c in cols) for r in df.select(*cols).collect()]
