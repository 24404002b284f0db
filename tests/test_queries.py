"""Every registered query runs; those with an oracle must agree with it."""

import pytest
from harness import difference, duck

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def con(base):
    return duck(base)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, base, con, name):
    frame = entry.queries()[name](spark, base)
    if name in entry.oracle_sql():
        assert difference(frame, con, entry.oracle_sql()[name]) is None
    else:
        assert frame.columns
        frame.collect()


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
