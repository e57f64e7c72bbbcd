import __spark_entry__ as entry


def test_every_sql_has_a_query_and_names_agree():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100
    assert all(n in queries for n in ("p5_found", "p6_found", "p7_found"))
