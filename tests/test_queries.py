"""Every query of the library against its SQL."""

import pytest
from chronofold.plans import catalog

from tests.conftest import SF, SF_TINY
from tests.oracle import connect, rows_of, rows_of_sql


@pytest.fixture(scope="module")
def con():
    return connect(SF_TINY)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    names, got = rows_of(spark, catalog.QUERIES[name], SF_TINY)
    sql_names, want = rows_of_sql(con, catalog.ORACLE_SQL[name])
    assert names == sql_names
    assert got == want
    assert got


def test_every_sql_has_a_query():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_key_capacity_against_a_fold(spark):
    from chronofold.operators.admission import key_capacity
    from chronofold.sources.changelog import cmd_log

    commands = cmd_log(spark, SF).select("global_seq", "kind", "key").orderBy("global_seq").collect()
    live, want = set(), []
    for r in commands:
        ok = r["kind"] == 2 or r["key"] in live or len(live) < 50
        if ok and r["kind"] == 1:
            live.add(r["key"])
        if r["kind"] == 2:
            live.discard(r["key"])
        want.append((r["global_seq"], "EXECUTE" if ok else "RESOURCE_EXHAUSTED"))
    assert [tuple(r) for r in key_capacity(cmd_log(spark, SF), 50).orderBy("global_seq").collect()] == want
