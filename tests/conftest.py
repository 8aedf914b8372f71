import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
for p in (ROOT, ROOT / "tools"):
    sys.path.insert(0, str(p))

from panelweave.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", 8, shuffle_partitions=4, memory="6g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def rows(df, *cols):
    """Rows as tuples, sorted, of the given columns."""
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)
