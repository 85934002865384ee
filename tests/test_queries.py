"""Every registered query against its SQL, and the contract of the entry module."""

import compare
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


def test_contract(spark):
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and {f"p{n}_found" for n in range(1, 6)} <= set(sql)
    assert entry.entry(spark).columns == ["id_medico", "id_clinica", "clase", "desde", "hasta"]


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    assert compare.spark_rows(entry.queries()[name](spark, SF)) == compare.duck_rows(con, entry.oracle_sql()[name])
