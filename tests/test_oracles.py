"""Every registered query with SQL agrees with DuckDB on the smallest data."""

import pytest

from lexiloom.plans import registry
from tests.compare import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_agrees(spark, name):
    assert compare(spark, SF, registry.queries()[name], registry.oracles()[name]) == []


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracles())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
