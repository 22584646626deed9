"""The driver's contract."""

import __spark_entry__


def test_every_query_is_callable_and_oracles_belong_to_queries():
    queries = __spark_entry__.queries()
    assert {"p3_found", "p3_report", "p4_found"} <= set(queries) and all(map(callable, queries.values()))
    assert set(__spark_entry__.oracle_sql()) <= set(queries)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["ref_table", "ref_field", "period", "state", "orphans"]
