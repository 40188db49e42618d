"""All queries of the subpackage run on the smallest tables and have the columns that are asked for."""

import pytest

from loomstore.llm.queries import QUERIES, SQL

COLUMNS = {
    "p1_found": ["input_id bigint"], "p2_found": ["decision_a bigint", "decision_b bigint"], "p4_found": ["memory_id string", "pii_kind string"], "p5_found": ["first_id string", "copy_id string"],
    "p7_found": ["first_id string", "best_id string"], "p9_found": ["doc_id bigint", "item_id bigint"], "p10_found": ["doc_id bigint"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    if name in COLUMNS:
        assert [" ".join(x) for x in df.dtypes] == COLUMNS[name]
        assert len(set(rows)) == len(rows)


def test_sql_has_queries():
    assert set(SQL) <= set(QUERIES)
