"""The operators' queries against their SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from plumbline.llm.queries import ORACLE_SQL, QUERIES

from ..oracle import differences


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, small_dir, name):
    assert differences(QUERIES[name], ORACLE_SQL[name], spark, small_dir) == ""
