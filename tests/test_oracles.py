"""Every registered query against its SQL text on the smallest tables."""

import pytest
from compare import compare
from conftest import SMALL

from postsift.plans import catalog

# Valid answers that happen to be empty on the smallest tables.
MAY_BE_EMPTY = {"lsh_pairs", "lsh_pairs_one_domain", "missing_labels"}


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_matches_sql(spark, duck, name):
    outcome = compare(spark, duck, name, SMALL)
    assert outcome == "" or (outcome == "no rows" and name in MAY_BE_EMPTY)


def test_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 60


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
