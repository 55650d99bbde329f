import __spark_entry__ as entry


def test_flagship_query(spark):
    table = entry.entry(spark)
    assert table.columns[:2] == ["method", "count"]
    assert [r["method"] for r in table.collect()] == ["beam", "penalty", "raw", "sft"]


def test_registered_names():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert len(queries) > 70 and set(oracles) < set(queries)
    assert all(callable(q) for q in queries.values()) and all(isinstance(s, str) for s in oracles.values())
