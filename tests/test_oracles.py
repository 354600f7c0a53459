"""Every query of the product engine against its SQL, at the smallest scale."""

from __future__ import annotations

import pytest

from cotejo.plans import catalog
from tests.oracle import agree, connect

NAMES = sorted(catalog.oracle_sql())


@pytest.fixture(scope="module")
def db(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, sf_dir, db, name):
    agree(catalog.queries()[name](spark, sf_dir), catalog.oracle_sql()[name], db)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(NAMES)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
