import pytest
from oracle import connect, differences

from weftline.llm import queries

COLUMNS = {
    "p1_found": [("session_id", "string"), ("first_offset", "bigint"), ("last_offset", "bigint")],
    "p2_found": [("table_name", "string"), ("record_id", "bigint")],
    "p3_found": [("chunk_id", "bigint")],
    "p5_found": [("obs_id_a", "bigint"), ("obs_id_b", "bigint")],
    "p6_found": [("table_name", "string"), ("record_id", "bigint"), ("field_name", "string"), ("item_no", "int"), ("pii_type", "string"), ("char_start", "int")],
    "p9_found": [("doc_id", "bigint")],
}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    assert differences(spark, duck, queries.QUERIES[name], queries.ORACLE_SQL[name], sf_dir) == []


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs_over_its_tables(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    assert df.count() > 0 or name.startswith("p3_")  # the smallest tables hold no oversized chunk
    if name in COLUMNS:
        assert df.dtypes == COLUMNS[name]
        assert df.distinct().count() == df.count()
