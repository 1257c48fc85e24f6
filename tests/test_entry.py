import __spark_entry__ as entry


def test_queries_and_sql_agree():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 100
    assert all(callable(f) for f in q.values())


def test_training_queries_are_there():
    q = entry.queries()
    assert {"p2_found", "p3_found", "p5_found", "p7_found"} <= set(q)
