"""Every query with SQL against that SQL on the smallest tables."""

import pytest
from oracle import DATA, compare

from graphloom.plans import contract_queries, core_problems, graph_queries, reach_queries

CASES = [(k, m.QUERIES[k], m.SQL[k]) for m in (core_problems, graph_queries, reach_queries, contract_queries) for k in m.SQL]

@pytest.mark.parametrize("name,query,sql", CASES, ids=[c[0] for c in CASES])
def test_query(spark, name, query, sql):
    assert compare(spark, name, query, sql, str(DATA / "sf0.001")) == ""
