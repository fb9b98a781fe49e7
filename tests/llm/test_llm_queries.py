"""Queries of the subpackage with SQL give the rows of that SQL; the others run and have their columns."""

import pytest

from tests.compare import same
from tradeloom.llm.queries import oracle_sql, queries

COLUMNS = {"p1_found": ["vendor_no", "txn_id"], "p3_found": ["line_no", "asset_id"], "p4_found": ["first_record_no", "field_name", "record_no"], "p5_found": ["vendor_no", "ptr_no"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "subject"]}


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows_as_sql(spark, data, name):
    same(queries()[name](spark, data).toPandas(), oracle_sql()[name], data)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, data, name):
    df = queries()[name](spark, data)
    assert df.columns == COLUMNS[name] and df.count() > 0
