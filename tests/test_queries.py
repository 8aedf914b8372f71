"""Every registered query against its DuckDB counterpart on the smallest tables."""

from concurrent.futures import ThreadPoolExecutor

import check
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from panelweave.plans.fixtures import Tables

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def answers(spark, request):
    """Outcome of the selected queries; independent queries run side by side."""
    Tables(spark, FOLDER).bars  # stored once before the threads start
    con = check.connect(FOLDER)

    def one(name):
        try:
            df = QUERIES[name](spark, FOLDER)
            return check.compare(df, con.cursor(), ORACLES[name]) if name in ORACLES else (df.count() > 0, "no rows")
        except Exception as e:  # shown by the test of this query
            return False, f"{type(e).__name__}: {e}"

    names = [i.callspec.params["name"] for i in request.session.items if "name" in getattr(getattr(i, "callspec", None), "params", {})]
    with ThreadPoolExecutor(6) as pool:
        return dict(zip(names, pool.map(one, names)))


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry(spark).count() == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(answers, name):
    ok, note = answers[name]
    assert ok, note
