from pathlib import Path

import pytest

from tests.oracle import assert_same
from windrow.plans import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, tiny, name):
    assert_same(registry.queries()[name](spark, tiny), registry.oracle_sql()[name], tiny)


def test_queries_without_sql_have_a_brute_force_test():
    with open(Path(__file__).with_name("test_brute.py")) as f:
        tested = f.read()
    missing = [n for n in set(registry.queries()) - set(registry.oracle_sql()) if f'run("{n}")' not in tested and f'"{n}"' not in tested]
    assert missing == []


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
