"""Every registered catalogue query against its oracle; those without one must give rows."""

import pytest

import __spark_entry__ as entry
from oracle import assert_same, connect

QUERIES = {k: q for r in entry.REGISTRIES for k, q in r.queries.items()}
ORACLES = {k: s for r in entry.REGISTRIES for k, s in r.oracles.items()}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    frame = QUERIES[name](spark, sf_dir).toPandas()
    if name in ORACLES:
        assert_same(frame, con.execute(ORACLES[name]).df())
    else:
        assert len(frame)


def test_entry_point(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
