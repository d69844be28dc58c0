import pytest

from attestor.llm import queries
from compare import connect, same


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, data, con, name):
    same(spark, con, data, queries.QUERIES[name], queries.SQL[name])


COLUMNS = {
    "p1_found": ["passage_id", "line_no"], "p2_found": ["record_kind", "group_id", "record_id"], "p3_found": ["claim_a", "claim_b"], "p3_recall": ["embed_model", "asked", "recalled"], "p4_found": ["passage_id"],
    "p5_found": ["passage_id", "line_no"], "p6_ids": ["doc_id", "ids"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "char_start", "char_end", "pii_type"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    assert df.columns == COLUMNS[name]
    rows = df.collect()
    assert (rows or name == "p3_recall") and len({str(r) for r in rows}) == len(rows)
