"""Every registered query against its checking SQL."""

import pytest

from larder.check import compare
from larder.plans import load_all

REGISTRY = load_all()


@pytest.mark.parametrize("key", sorted(REGISTRY))
def test_query_matches_sql(spark, con, sf_dir, key):
    ok, message, _, _ = compare(spark, con, sf_dir, REGISTRY[key])
    assert ok, message


def test_every_query_has_checking_sql():
    assert [k for k, q in REGISTRY.items() if q.sql is None] == []
