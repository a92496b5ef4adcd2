import re

import pytest

import __spark_entry__ as registry
from checks.compare import compare, database

SF = "/root/testdata/sf0.001"


def test_every_check_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert all(re.fullmatch(r"[a-z0-9_]+", name) for name in registry.queries())


@pytest.mark.parametrize("name", ["hybrid_topk", "skill_evidence", "honeypot_penalty", "job_requirements", "reward_means"])
def test_queries_agree_with_their_sql(spark, name):
    message = compare(spark, database(SF), name, registry.queries()[name], registry.oracle_sql()[name], SF)
    assert ": ok" in message, message


def test_entry_returns_a_full_shortlist(spark):
    assert registry.entry(spark).count() == 100
