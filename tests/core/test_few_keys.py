"""Joins on keys of few values make no task a value."""

import pytest

from ledgerline import plans

from ..conftest import SMALL


@pytest.mark.parametrize(("name", "key"), [("file_matches", "agent_fk"), ("bucket_list", "bucket"), ("phrase_licenses", "phrase_pk"), ("imported_bill", "_n")])
def test_rows_are_not_dealt_by_a_key_of_few_values(spark, name, key):
    plan = plans.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(" in plan and f"hashpartitioning({key}#" not in plan
