"""Every registered query vs its DuckDB oracle on sf0.001 (the driver runs sf0.01)."""

import pytest

from oracle import compare

from kwspread.plans.registry import load_all

SF = "/root/testdata/sf0.001"
REG = load_all()


@pytest.mark.parametrize("name", sorted(REG))
def test_query_matches_oracle(spark, name):
    q = REG[name]
    r = compare(spark, name, q.build, q.sql, SF)
    if q.sql is None:
        assert r["spark_rows"] >= 0
    else:
        assert r["schema_match"], r
        assert r["spark_rows"] == r["oracle_rows"], r
        assert r["hash_match"], r


def test_entry_contract(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
